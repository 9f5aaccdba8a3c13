"""Operator 1: benchmark decontamination.

The benchmark's normalised word windows become a compact hash index that is broadcast; each
task scans the word windows of its texts against it, verifies every hash hit word for word, and
marks, cuts or drops what is contaminated.

The index is broadcast in blocks: a block holds at most ``block_bytes`` of benchmark text, so a
broadcast has a fixed bound whatever the benchmark's size.  A benchmark of more than one block
first goes into a table of ``2 ** SIEVE_BITS`` bits, one for the hash of each window; only documents
with a window whose bit is set then pass the blocks one after another, the hits so far travelling
with the row and the rows checkpointed between blocks.  The others, nearly all, are scanned once
and never written.  No shuffle is needed.

Defined results: null text has no words; an item without words has no window; items that share
a window all count; repeated rows are scanned one by one; an empty benchmark contaminates
nothing; an item without id marks words but isn't listed.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordscan
from .frames import checkpointed, map_batches, set_aside

BLOCK_BYTES = 16 << 20
SIEVE_BITS = 27
_SLOTS = 20
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_OWN = ["n_words", "n_hit", "items", "spans", "contaminated"]


class WindowIndex:
    """Sorted hashes of one block's windows, a small bit table before them, and the texts to
    verify against."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.ids = [i for i, _ in items]
        words = wordscan.Words(*wordscan.text_buffers(pa.array([t for _, t in items], pa.large_string())))
        counts = words.counts
        # The words again, one space between two: a window is then one slice.
        self.text = words.joined(0, len(words.starts))
        lengths = words.ends - words.starts
        self.begin = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.end = self.begin + lengths
        self.tables: dict[int, tuple] = {}
        for k in sorted({int(min(c, n)) for c in counts if c}):
            hashes, at = words.grams(k)
            item = words.texts[at]
            use = counts[item] >= n if k == n else counts[item] == k
            hashes, at, item = hashes[use], at[use], item[use]
            order = np.argsort(hashes, kind="stable")
            hashes, at, item = hashes[order], at[order], item[order]
            bits = np.zeros(1 << _SLOTS, bool)
            bits[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
            self.tables[k] = (hashes, at, item, bits)

    def sieve(self, table: np.ndarray) -> None:
        """Set the bits of all windows."""
        for hashes, *_ in self.tables.values():
            at = hashes >> np.uint64(64 - SIEVE_BITS)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def hits(self, words: wordscan.Words):
        """(first word, length, items) of each verified window of the scanned texts."""
        for k, (hashes, at, item, bits) in self.tables.items():
            found, where = words.grams(k)
            maybe = np.flatnonzero(bits[(found >> np.uint64(64 - _SLOTS)).astype(np.int64)])
            left = np.searchsorted(hashes, found[maybe])
            right = np.searchsorted(hashes, found[maybe], "right")
            for m, lo, hi in zip(maybe[right > left], left[right > left], right[right > left]):
                i = int(where[m])
                text = words.joined(i, i + k)
                same = [int(item[j]) for j in range(lo, hi) if self.text[self.begin[at[j]] : self.end[at[j] + k - 1]] == text]
                if same:
                    yield i, k, same


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """Lists of (item, text) of at most ``limit`` bytes or one item; one partition at a time
    reaches the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        length = len(row[1].encode())
        if block and size + length > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += length
    if block:
        yield block


def _sifter(shared, text_col: str):
    """Marks texts with a window whose bit is set."""

    def make():
        table, sizes = shared.value

        def work(batch: pa.RecordBatch):
            for lo, hi, words in wordscan.scan(batch.column(text_col)):
                maybe, texts = np.zeros(hi - lo, bool), words.texts
                for k in sizes:
                    found, where = words.grams(k)
                    at = found >> np.uint64(64 - SIEVE_BITS)
                    hit = table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
                    maybe[texts[where[hit > 0]]] = True
                yield lo, hi, {"n_words": pa.array(words.counts.astype(np.int64)), "_maybe": pa.array(maybe)}

        return work

    return make


def _marker(shared, text_col: str, first: bool):
    def make():
        index: WindowIndex = shared.value

        def work(batch: pa.RecordBatch):
            column = batch.column(text_col)
            for lo, hi, words in wordscan.scan(column):
                n = hi - lo
                hit, items = np.zeros(len(words.starts), bool), [set() for _ in range(n)]
                if not first:
                    for d, (spans, had) in enumerate(zip(batch.column("_words").slice(lo, n).to_pylist(), batch.column("items").slice(lo, n).to_pylist())):
                        items[d].update(had)
                        hit[np.asarray(spans, np.int64) + words.of_text[d]] = True
                texts = words.texts
                for i, k, same in index.hits(words):
                    hit[i : i + k] = True
                    items[texts[i]].update(index.ids[j] for j in same if index.ids[j] is not None)
                where = np.flatnonzero(hit)
                per = np.bincount(texts[where], minlength=n) if n else np.zeros(0, np.int64)
                at = where - words.of_text[texts[where]]
                yield lo, hi, {
                    "n_words": pa.array(words.counts.astype(np.int64)),
                    "_words": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), pa.array(at.astype(np.int32))),
                    "items": pa.array([sorted(x, key=str.encode) for x in items], pa.list_(pa.string())),
                    "spans": _spans(words, where, per),
                }

        return work

    return make


def _spans(words: wordscan.Words, where: np.ndarray, per: np.ndarray) -> pa.Array:
    """Code-point spans of runs of hit words, from the first word's start to the last's end."""
    out, lo = [], 0
    for d, count in enumerate(per):
        w = where[lo : lo + count]
        lo += count
        if not count:
            out.append([])
            continue
        cut = np.flatnonzero(np.diff(w) > 1)
        a, b = w[np.concatenate(([0], cut + 1))], w[np.concatenate((cut, [count - 1]))]
        data = words.data[words.offsets[d] : words.offsets[d + 1]]
        starts = wordscan.char_offsets(data, words.starts[a] - words.offsets[d])
        ends = wordscan.char_offsets(data, words.ends[b] - words.offsets[d])
        out.append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words, n_hit`` (words inside any occurring window), ``items`` (sorted ids of items
    with occurring windows), ``spans`` (code-point ranges of runs of hit words), ``contaminated``.

    A window is ``n`` consecutive words of an item; an item of fewer words is one window.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if keep is None or c in keep]
    docs = set_aside(docs.select(*dict.fromkeys([*keep, text_col])), [c for c in [*_OWN, "_words", "_maybe"] if c != text_col])
    columns = docs.columns
    added = [("n_words", T.LongType()), ("_words", T.ArrayType(T.IntegerType(), False)), ("items", T.ArrayType(T.StringType())), ("spans", _SPANS)]
    blocks = lambda: _blocks(benchmark, item_col, item_text_col, block_bytes)
    out, first, rest = docs, True, None
    if len(list(itertools.islice(blocks(), 2))) > 1:
        table, sizes = np.zeros(1 << SIEVE_BITS - 3, np.uint8), set()
        for block in blocks():
            index = WindowIndex(block, n)
            index.sieve(table)
            sizes |= set(index.tables)
        sifted = map_batches(docs, [("n_words", T.LongType()), ("_maybe", T.BooleanType())], _sifter(spark.sparkContext.broadcast((table, sorted(sizes))), text_col), keep=columns)
        none = [F.array().cast(kind).alias(name) for name, kind in added[1:]]
        rest = sifted.where(~F.col("_maybe")).select(*columns, "n_words", *none)
        out = sifted.where("_maybe").select(*columns)
    for block in blocks():
        if not first:
            out = checkpointed(out)
        shared = spark.sparkContext.broadcast(WindowIndex(block, n))
        out = map_batches(out, added, _marker(shared, text_col, first), keep=columns)
        first = False
    if first:
        out = map_batches(docs, added, _marker(spark.sparkContext.broadcast(WindowIndex([], n)), text_col, True), keep=columns)
    if rest is not None:
        out = out.unionByName(rest)
    kept = [c for c in columns if c != text_col or text_col in keep]
    return out.select(*kept, "n_words", F.size("_words").cast("long").alias("n_hit"), "items", "spans", (F.size("_words") > 0).alias("contaminated"))


def _without_spans(text: Column, spans: Column) -> Column:
    """The text between and around the spans, joined."""
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            text,
            (F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]) + 1).cast("int"),
            (F.coalesce(F.get(spans, i)["start"], F.char_length(text).cast("long")) - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])).cast("int"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(gaps, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """``remove="documents"`` drops contaminated rows; ``"spans"`` cuts the hit spans from the
    text.  The columns of ``docs`` are returned as they came."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove: 'documents' or 'spans'")
    names = docs.columns
    marked = mark_contamination(docs, benchmark, text_col=text_col, **options)
    if remove == "documents":
        marked = marked.where(~F.col("contaminated"))
    else:
        marked = marked.withColumn(text_col, _without_spans(F.col(text_col), F.col("spans")))
    return marked.select(*marked.columns[: len(names)]).toDF(*names)
