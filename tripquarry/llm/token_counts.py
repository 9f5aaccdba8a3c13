"""Operator 7: token counts by offset-mapped attribution.

A whole document is encoded once.  The tokens' character spans are then joined to the spans of
the document's fields or sections (sorted starts on both sides, one binary search for each end of
a token), and a token that crosses a boundary is allocated by one of four explicit rules:

    first   the span of its first character
    last    the span of its last character
    most    the span that holds most of its characters, the earlier on ties
    split   shares by characters

A token that begins or ends inside a character (byte-level tokens may) has that character in its
span.

Defined results: null fields and texts are empty; an empty text has one section without tokens;
an empty field has no tokens; repeated rows are counted alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import byte_bpe, wordscan
from .frames import aside, map_batches, set_aside

RULES = ("first", "last", "most", "split")


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, which tokens cross).  Section i is ``bounds[i]:bounds[i + 1]``;
    token spans are sorted and not empty; empty sections get nothing."""
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    cross = last > first
    to = last if rule == "last" else first
    total = np.bincount(to[~cross] if rule in ("most", "split") else to, minlength=n).astype(np.float64)
    if rule in ("most", "split"):
        for i in np.flatnonzero(cross):
            cut = np.clip(bounds[first[i] : last[i] + 2], starts[i], ends[i])
            held = np.diff(cut)
            if rule == "most":
                total[first[i] + int(held.argmax())] += 1
            else:
                total[first[i] : last[i] + 1] += held / held.sum()
    return total, cross


def _char_spans(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans, over all texts of a slice, of consecutive tokens of these byte lengths."""
    ends = np.cumsum(lengths)
    number = np.cumsum((data & 0xC0) != 0x80) - 1
    return number[ends - lengths], number[ends - 1] + 1


def _worker(shared, text_col: str, rule: str, bounds_of):
    """``bounds_of(batch, data, offsets, lo, hi)`` gives each text's section ends (bytes)."""

    def make():
        encoder = byte_bpe.Encoder(shared.value)

        def work(batch: pa.RecordBatch):
            data, offsets = wordscan.text_buffers(batch.column(text_col))
            for lo, hi in wordscan.slices(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ids, counts = encoder.encode(part, own)
                ends, per = bounds_of(batch, part, own, lo, hi)
                if len(part):
                    starts, stops = _char_spans(part, encoder.tokenizer.lengths[ids])
                    chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                    total, cross = allocate(starts, stops, np.concatenate(([0], chars[ends])), rule)
                else:
                    total, cross, chars = np.zeros(len(ends)), np.zeros(0, bool), np.zeros(1, np.int64)
                text = np.repeat(np.arange(hi - lo), counts)
                yield lo, hi, {
                    "n_tokens": pa.array(counts, pa.int64()),
                    "n_crossing": pa.array(np.bincount(text[cross], minlength=hi - lo), pa.int64()),
                    "section_tokens": byte_bpe._lists(total, per, pa.float64()),
                    "section_ends": byte_bpe._lists(chars[ends] - np.repeat(chars[own[:-1]], per), per, pa.int64()),
                }

        return work

    return make


_ADDED = [("n_tokens", T.LongType()), ("n_crossing", T.LongType()), ("section_tokens", T.ArrayType(T.DoubleType(), False)), ("section_ends", T.ArrayType(T.LongType(), False))]


def _lines(batch, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Sections are lines, each with the newline that ends it."""
    breaks = np.flatnonzero(data == 10) + 1
    closed = np.isin(offsets[1:], breaks) & (np.diff(offsets) > 0)  # a text that ends with a newline
    ends = np.sort(np.concatenate((breaks, offsets[1:][~closed])), kind="stable")
    # Sections of each text: its newlines, and one for what follows the last.
    per = np.searchsorted(breaks, offsets[1:], "right") - np.searchsorted(breaks, offsets[:-1], "right") + ~closed
    return ends, per


def count_section_tokens(docs: DataFrame, tokenizer: byte_bpe.Tokenizer, *, rule: str = "most", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens, n_crossing`` (tokens that cross a boundary), ``section_tokens`` and
    ``section_ends`` (characters) for the lines of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    docs, keep = aside(docs, [n for n, _ in _ADDED if n != text_col], keep)
    return map_batches(docs, _ADDED, _worker(shared, text_col, rule, _lines), keep)


def count_field_tokens(docs: DataFrame, tokenizer: byte_bpe.Tokenizer, fields: list[str], *, separator: str = "\n", rule: str = "most") -> DataFrame:
    """Add ``n_tokens, n_crossing, field_tokens`` (a struct with a number for each field) of the
    document that joins the fields with the separator; separators count with the field before."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    own = set_aside(docs, ["_whole", "_sizes", "field_tokens", *(n for n, _ in _ADDED)])
    names = [own.columns[docs.columns.index(f)] for f in fields]
    values = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    values = [F.concat(v, F.lit(separator)) if i < len(values) - 1 else v for i, v in enumerate(values)]
    whole = own.withColumns({"_whole": F.concat(*values), "_sizes": F.array(*[F.octet_length(v) for v in values])})
    k = len(fields)

    def bounds(batch, data, offsets, lo, hi):
        sizes = batch.column("_sizes").slice(lo, hi - lo).flatten().to_numpy().reshape(-1, k)
        return (offsets[:-1, None] + np.cumsum(sizes, 1)).ravel(), np.full(hi - lo, k)

    out = map_batches(whole, _ADDED, _worker(shared, "_whole", rule, bounds), own.columns)
    return out.select(*own.columns, "n_tokens", "n_crossing", F.struct(*[F.get("section_tokens", F.lit(i)).alias(f) for i, f in enumerate(fields)]).alias("field_tokens"))
