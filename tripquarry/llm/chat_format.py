"""Operator 4: chat formatting of typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one string: texts are
escaped, every other part becomes a numbered placeholder, and its reference and the number of
tokens it will expand to are recorded.  A conversation is

    <|turn|>ROLE<|says|>CONTENT<|end|>\\n   for each turn, in order

Escaping is reversible and leaves no control string inside a text: a backslash is doubled and the
first character of a control string (this template's and the common ones of others) is followed
by a backslash.  The loss mask covers assistant content.

Turns are dealt by conversation and sorted within partitions; a task streams over its sorted rows
and holds one conversation at a time, which is one row of the result.

Defined results: turns are ordered by turn, role, text and parts, nulls first; null text, role and
parts are empty; a part of an unknown type becomes a placeholder of type "unknown" with its
reference; a size that is missing, not finite, not positive or beyond ``PartVisitor.MOST`` tokens
counts as ``PartVisitor.UNKNOWN`` tokens; repeated rows are repeated turns; a null conversation id is one conversation; an empty table
gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import bound_batches

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
# Control strings that must not survive inside a text.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_PLACE = re.compile(r"<\|(image|audio|document|unknown):(\d+)\|>")

PART = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("width", "height", "seconds", "pages")]
)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


class PartVisitor:
    """Flattens parts; numbers attachments across the conversation."""

    #: Side of an image patch; tokens of a second of audio and of a page; of an unknown size; the
    #: most that a part is taken to have.
    PATCH, PER_SECOND, PER_PAGE, UNKNOWN, MOST = 28, 25, 512, 256, 1 << 40

    def __init__(self):
        self.attachments: list[dict] = []
        self.turn = 0

    def visit(self, part: dict | None) -> str:
        part = part or {}
        known = {"text": self.text, "image": self.image, "audio": self.audio, "document": self.document}
        return known.get(part.get("type") or "text", self.unknown)(part)

    def text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def image(self, part: dict) -> str:
        return self._place("image", part, self._units(part.get("width"), 1 / self.PATCH) * self._units(part.get("height"), 1 / self.PATCH))

    def audio(self, part: dict) -> str:
        return self._place("audio", part, self._units(part.get("seconds"), self.PER_SECOND))

    def document(self, part: dict) -> str:
        return self._place("document", part, self._units(part.get("pages"), self.PER_PAGE))

    def unknown(self, part: dict) -> str:
        return self._place("unknown", part, 0)

    def _units(self, size: float | None, each: float) -> int:
        """Whole units of a size, or 0 where it tells none."""
        if size is None or not math.isfinite(size) or not 0 < size * each <= self.MOST:
            return 0
        return math.ceil(size / round(1 / each)) if each < 1 else math.ceil(size * each)

    def _place(self, kind: str, part: dict, tokens: int) -> str:
        n = len(self.attachments)
        tokens = tokens if 0 < tokens <= self.MOST else self.UNKNOWN
        self.attachments.append({"turn": self.turn, "kind": kind, "number": n, "ref": part.get("ref") or "", "tokens": tokens})
        return f"<|{kind}:{n}|>"


class Conversation:
    """One conversation as it is built up, turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.visitor, self.out, self.length, self.loss = conv_id, PartVisitor(), [], 0, []

    def add(self, role: str | None, text: str | None, parts: list[dict] | None) -> None:
        flat = "".join(self.visitor.visit(p) for p in parts) if parts is not None else self.visitor.text({"text": text})
        head = f"{TURN}{escape(role or '')}{SAYS}"
        if role == "assistant":
            self.loss.append({"start": self.length + len(head), "end": self.length + len(head) + len(flat)})
        self.out.append(f"{head}{flat}{END}")
        self.length += len(self.out[-1])
        self.visitor.turn += 1


_SPAN = [("start", pa.int64()), ("end", pa.int64())]
_ATTACHED = [("turn", pa.int64()), ("kind", pa.string()), ("number", pa.int64()), ("ref", pa.string()), ("tokens", pa.int64())]
_SCHEMA = "conv_id {}, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>, attachments array<struct<turn:long,kind:string,number:long,ref:string,tokens:long>>, attachment_tokens long"


def format_chats(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row for each conversation: ``conv_id, n_turns, formatted, loss_spans`` (code points of
    ``formatted`` under the loss mask), ``attachments, attachment_tokens``.

    ``parts_col`` names a column of type ``array<PART>``; where it is null the text counts.
    """
    bound_batches(turns.sparkSession)
    parts = F.col(parts_col).cast(T.ArrayType(PART)) if parts_col else F.lit(None).cast(T.ArrayType(PART))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), parts.alias("parts"))
    kind = rows.schema["conv_id"].dataType
    order = ["conv_id", "turn", "role", "text", "parts"]
    dealt = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "parts")

    def run(batches):
        def emit(done: list[Conversation], id_type: pa.DataType):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([c.conv_id for c in done], id_type),
                    pa.array([len(c.out) for c in done], pa.int64()),
                    pa.array(["".join(c.out) for c in done], pa.string()),
                    pa.array([c.loss for c in done], pa.list_(pa.struct(_SPAN))),
                    pa.array([c.visitor.attachments for c in done], pa.list_(pa.struct(_ATTACHED))),
                    pa.array([sum(a["tokens"] for a in c.visitor.attachments) for c in done], pa.int64()),
                ],
                names=["conv_id", "n_turns", "formatted", "loss_spans", "attachments", "attachment_tokens"],
            )

        now, id_type = None, None
        for batch in batches:
            done, size, id_type = [], 0, batch.column(0).type
            for conv_id, role, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now)
                        size += now.length
                    if size > 4 << 20:
                        yield emit(done, id_type)
                        done, size = [], 0
                    now = Conversation(conv_id)
                now.add(role, text, parts)
            if done:
                yield emit(done, id_type)
        if now is not None:
            yield emit([now], id_type)

    return dealt.mapInArrow(run, _SCHEMA.format(kind.simpleString()))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, escaped content) of every turn, read from the formatted text alone."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError("not a formatted conversation")
        says = formatted.index(SAYS, at)
        end = formatted.index(END, says)
        turns.append((unescape(formatted[at + len(TURN) : says]), formatted[says + len(SAYS) : end]))
        at = end + len(END)
    return turns


def content_parts(content: str) -> list[tuple[str, str]]:
    """A turn's content as (type, text or attachment number)."""
    out, at = [], 0
    for m in _PLACE.finditer(content):
        if m.start() > at:
            out.append(("text", unescape(content[at : m.start()])))
        out.append((m[1], m[2]))
        at = m.end()
    if at < len(content):
        out.append(("text", unescape(content[at:])))
    return out


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted text says: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``."""
    kind = chats.schema["conv_id"].dataType

    def run(batches):
        for batch in batches:
            rows = []
            for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(formatted)
                whole = "".join(f"{role}\n{unescape(content)}\n" for role, content in turns)
                loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
