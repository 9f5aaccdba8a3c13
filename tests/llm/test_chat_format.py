import hashlib
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripquarry.llm import chat_format as C

TURNS = "conv_id long, turn long, role string, text string"


def digests(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn if turn is not None else -(10**9), role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(t[2], t[4]) for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


def test_round_trip_of_hostile_texts(spark):
    draw = random.Random(6)
    bits = ["<|", "|>", "<|end|>", "<|turn|>", "</s>", "[INST]", "[/INST]", "\\", "<", "|", "\n", "é😀", "user", "<|image:0|>", "<<SYS>>", " "]
    make = lambda: "".join(draw.choice(bits) for _ in range(draw.randint(0, 12)))
    rows = [(i // 5, i % 5, draw.choice(["user", "assistant", "system", make()]), make()) for i in range(400)]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", None), (500, None, None, None), (500, 1, "assistant", "a"), (500, 1, "assistant", "a"), (501, 0, "assistant", "long " * 50000)]
    chats = C.format_chats(spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit(1)))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.read_back(chats).collect()}
    assert got == digests(rows)
    for r in chats.collect():
        for _, content in C.parse(r["formatted"]):
            assert not any(c in content for c in C.CONTROL)


def test_parts_placeholders_and_tokens(spark):
    parts = "array(named_struct('type','text','text','see <|','ref',null,'width',null,'height',null,'seconds',null,'pages',null), named_struct('type','image','text',null,'ref','a.png','width',57d,'height',28d,'seconds',null,'pages',null), named_struct('type','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',2.01d,'pages',null), named_struct('type','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',3d), named_struct('type','image','text',null,'ref',null,'width',null,'height',null,'seconds',null,'pages',null))"
    frame = spark.createDataFrame([(1, 0, "user", "unused"), (1, 1, "assistant", "ok")], TURNS).withColumn("parts", F.expr(f"IF(turn = 0, {parts}, NULL)"))
    r = C.format_chats(frame, parts_col="parts").first()
    assert [(a["turn"], a["kind"], a["number"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", 0, "a.png", 3), (0, "audio", 1, "b.wav", 51), (0, "document", 2, "c.pdf", 1536), (0, "image", 3, "", 256)]
    assert r["attachment_tokens"] == 3 + 51 + 1536 + 256
    turns = C.parse(r["formatted"])
    assert C.content_parts(turns[0][1]) == [("text", "see <|"), ("image", "0"), ("audio", "1"), ("document", "2"), ("image", "3")]
    s = r["loss_spans"][0]
    assert r["formatted"][s["start"] : s["end"]] == "ok"


def test_odd_parts_have_defined_results(spark):
    part = lambda **x: {k: x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    nan, inf = float("nan"), float("inf")
    odd = [
        part(type="video", ref="v.mp4"), part(type="image", width=nan, height=5.0), part(type="image", width=-3.0, height=5.0), part(type="image", width=1e300, height=1e300),
        part(type="audio", seconds=inf), part(type="audio", seconds=0.0), part(type="document", pages=-1.0), part(type="document", pages=1e-9), part(text=None), None, part(type="text", text="t"),
    ]
    frame = spark.createDataFrame([(1, 0, "user", "unused", odd), (1, 0, "user", "unused", []), (1, 0, "user", "unused", odd)], T.StructType([*T.StructType.fromDDL(TURNS).fields, T.StructField("parts", T.ArrayType(C.PART))]))
    r = C.format_chats(frame.repartition(3), parts_col="parts").first()
    assert [(a["kind"], a["tokens"]) for a in r["attachments"][:8]] == [("unknown", 256), ("image", 256), ("image", 256), ("image", 256), ("audio", 256), ("audio", 256), ("document", 256), ("document", 1)]
    assert r["attachments"][0]["ref"] == "v.mp4" and len(r["attachments"]) == 16 and r["n_turns"] == 3
    assert [a["turn"] for a in r["attachments"]] == [1] * 8 + [2] * 8  # tied rows: by parts, so the empty ones first
    assert C.content_parts(C.parse(r["formatted"])[1][1])[-2:] == [("document", "7"), ("text", "t")]


def test_empty(spark):
    assert C.read_back(C.format_chats(spark.createDataFrame([], TURNS))).count() == 0
