"""Operator 6: near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all five-word shingles of all documents go into a count-min sketch of
   fixed size (each task adds up its own and emits it once; the sums are merged as streams).
2. Each text becomes weighted shingles, weight ``(1 + ln tf) * idf`` rounded on a logarithmic
   scale, and ``BANDS * ROWS`` improved consistent weighted samples.  Texts with the same words
   are one *content* (128-bit digest); they are grouped first, combined map-side.
3. Contents that share a band form a bucket.  A bucket never emits all pairs: its *hub* is the
   member whose buckets hold the most members in all, which is the text that others were copied
   from where there is one, and each content is tried against the best hub of its buckets, so
   there is one candidate link a content at most.
4. The shingles of contents in buckets are written once.  Links are verified on them by exact
   weighted Jaccard similarity and closed to classes by distributed connected components.
5. In every bucket that still holds two classes, every pair of members in two classes is compared
   exactly, in blocks of bounded size.  So no pair that shares a band and reaches the threshold is
   left in two classes, and the result depends on no order or partition of the rows.

``idf = ln(1 / max(share, FULL))`` for the share of documents that hold a shingle: shingles in up to
``FULL`` of all documents (also those of sizeable groups of copies) count in full, and more
frequent ones, such as lines and passages that many texts share, less and less.  A counter of the
sketch errs by about words a document / 2 ** SKETCH_BITS of all documents, whatever their number,
which is far below ``FULL``: the weights behave alike at every size.  ``PRIOR`` documents without
any shingle are counted too, so that a small collection has no frequent ones by chance.

Defined results: a text of one to four words has one shingle, all its words; a text without words
(null, empty, punctuation) is a class of its own; repeated rows and equal texts are one class; the
class id is the least ``doc_id`` of the class, nulls last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import parts, wordscan
from .components import connected_components
from .frames import bound_batches, checkpointed, map_batches, released, set_aside

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 400_000  # of a block of a bucket
SKETCH_BITS, SKETCH_ROWS = 18, 2
FULL = 0.05  # share of documents up to which a shingle counts in full
PRIOR = 20_000  # documents without it that a shingle's share also counts
STEPS = 32  # weight levels to a factor of e
WANTED_BITS = 22  # of the table that tells which rows' shingles are worth sending
_DRAWS = 16  # bits of the table of random draws
_U = np.uint64


def shingles(words: wordscan.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle, in text order."""
    found, at = words.grams(k)
    texts = words.texts
    of = texts[at]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra_h, extra_t = [found], [of]
        for n in np.unique(counts[short]).tolist():
            h, a = words.grams(n)
            whole = counts[texts[a]] == n
            extra_h.append(h[whole])
            extra_t.append(texts[a[whole]])
        found, of = np.concatenate(extra_h), np.concatenate(extra_t)
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    return found, of


def counted(found: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, tf) of the distinct shingles of each text, sorted by text and hash."""
    order = np.lexsort((found, of))
    h, t = found[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))


def _slots(h: np.ndarray, row: int) -> np.ndarray:
    return (h * _U(0xC2B2AE3D27D4EB4F + 2 * row * 0x165667B19E3779F9 & (1 << 64) - 1) >> _U(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, text_col: str, k: int = SHINGLE) -> tuple[np.ndarray, int]:
    """(count-min sketch of document frequencies, documents), over all rows."""
    bound_batches(docs.sparkSession)
    size = SKETCH_ROWS << SKETCH_BITS

    def count(batches):
        total = np.zeros(parts.padded(size + 1), np.int64)  # the last part: documents
        for batch in batches:
            for lo, hi, words in wordscan.scan(batch.column(0)):
                h, _, _ = counted(*shingles(words, k))
                for r in range(SKETCH_ROWS):
                    slots, c = np.unique(_slots(h, r), return_counts=True)
                    total[slots + (r << SKETCH_BITS)] += c
                total[size] += hi - lo
        yield from parts.emitted(total)

    total = parts.merged(docs.select(text_col).mapInArrow(count, parts.SCHEMA), size + 1)
    return total[:size].reshape(SKETCH_ROWS, -1), int(total[size])


class Weigher:
    """Weight levels of shingles, the samples drawn from them, and similarities."""

    def __init__(self, sketch: np.ndarray, n: int, k: int = SHINGLE, full: float = FULL):
        self.k = k
        # Log of idf for every counter of the sketch, as its share of the largest idf; shingles
        # of nearly all documents keep a twentieth, so that a text of nothing else has a weight.
        share = np.maximum(np.minimum(sketch, n) / (n + PRIOR), full)
        self.log_idf = np.log(np.maximum(np.log(share) / np.log(full), 0.05)).astype(np.float32)
        self._tables, self._row_of = np.zeros((0, 1 << _DRAWS), np.uint32), np.full(256, -1)

    def __getstate__(self):
        return {**self.__dict__, "_tables": self._tables[:0], "_row_of": np.full(256, -1)}

    def weighted(self, words: wordscan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, level) of each text's distinct shingles; the weight is
        e ** (level / STEPS), and levels lie between 0 and 200."""
        h, t, tf = counted(*shingles(words, self.k))
        log_idf = np.max([self.log_idf[r, _slots(h, r)] for r in range(len(self.log_idf))], axis=0) if len(h) else np.zeros(0)
        return h, t, np.rint((np.log1p(np.log(tf)) + log_idf - np.log(0.05)) * STEPS).astype(np.int64)

    def _rows(self, level: np.ndarray) -> np.ndarray:
        """For each weight level, the row of ``_tables`` with the sampling value ``a`` of every
        possible draw (as sortable bits).

        Improved consistent weighted sampling: r, c ~ Gamma(2, 1), b ~ U(0, 1);
        t = floor(ln S / r + b); ln a = ln c - r (t - b) - r.
        """
        new = [x for x in np.flatnonzero(np.bincount(level, minlength=1)).tolist() if self._row_of[x] < 0]
        if new:
            draw = np.random.default_rng(1905)
            size = 1 << _DRAWS
            r, c, b = draw.gamma(2, 1, size), draw.gamma(2, 1, size), draw.random(size)
            found = []
            for x in new:
                t = np.floor(x / STEPS / r + b)
                a = np.exp(np.log(c) - r * (t - b) - r)
                found.append(a.astype(np.float32).view(np.uint32))  # positive floats sort as their bits
            self._row_of[new] = len(self._tables) + np.arange(len(new))
            self._tables = np.concatenate((self._tables, found))
        return self._row_of[level]

    def bands(self, h: np.ndarray, t: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
        """A row of band hashes for each text that has shingles (others: zeros)."""
        out = np.zeros((n, BANDS), np.int64)
        if not len(h):
            return out
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        base = self._rows(level) << _DRAWS
        tables = self._tables.ravel()
        low = (h & _U(0xFFFFFFFF)).astype(np.uint64)
        seeds = np.random.default_rng(31).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
        shift, up = _U(64 - _DRAWS), _U(32)
        for band in range(BANDS):
            key = np.full(len(first), band + 1, np.uint64)
            for row in range(ROWS):
                at = (h * seeds[band * ROWS + row] >> shift).astype(np.int64)
                at += base
                least = np.minimum.reduceat(tables[at].astype(np.uint64) << up | low, first)
                key = wordscan.mixed(key * _U(0x9E3779B97F4A7C15) + least)
            out[t[first], band] = key.view(np.int64)
        return out

    @staticmethod
    def similarity(ha: np.ndarray, la: np.ndarray, hb: np.ndarray, lb: np.ndarray) -> float:
        """Weighted Jaccard similarity of two texts' sorted shingles."""
        _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
        wa, wb = np.exp(la / STEPS), np.exp(lb / STEPS)
        common = np.minimum(wa[i], wb[j]).sum()
        return float(common / max(wa.sum() + wb.sum() - common, 1e-300))


def content_keys(words: wordscan.Words, n: int) -> list[bytes | None]:
    """A 128-bit digest of each text's sequence of words; None without words."""
    raw, of = memoryview(np.ascontiguousarray(words.hashes)).cast("B"), (words.of_text * 8).tolist()
    return [hashlib.blake2b(raw[of[d] : of[d + 1]], digest_size=16).digest() if of[d + 1] > of[d] else None for d in range(n)]


def _features(shared, text_col: str, with_bands: bool):
    def make():
        weigher = shared.value if with_bands else None

        def work(batch: pa.RecordBatch):
            for lo, hi, words in wordscan.scan(batch.column(text_col)):
                new = {"_key": pa.array(content_keys(words, hi - lo), pa.binary())}
                if weigher is not None:
                    new["_size"] = pa.array(words.counts.astype(np.int64))
                    bands = weigher.bands(*weigher.weighted(words), hi - lo)
                    new["_bands"] = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS).astype(np.int32)), pa.array(bands.ravel()))
                yield lo, hi, new

        return work

    return make


def _compared(threshold: float):
    """Links between classes in groups of (bucket, i, j): strangers of block i against members of
    block j, every pair that is in two classes, by exact similarity.

    Of the links found in a group, those whose ends are joined by earlier ones of it are left out.
    """

    def links(rows):
        pos, i, j = rows[0]["pos"], rows[0]["i"], rows[0]["j"]
        keys = [r["key"] for r in rows]
        names = sorted({r["root"] for r in rows})
        number = {x: n for n, x in enumerate(names)}
        label = np.array([number[r["root"]] for r in rows])
        stranger = np.array([r["s"] >= 0 for r in rows])
        left, right = np.array([r["s"] == i for r in rows]), np.array([r["o"] == j for r in rows])
        rank = np.empty(len(rows), np.int64)
        rank[sorted(range(len(rows)), key=keys.__getitem__)] = np.arange(len(rows))
        earlier = np.array([r["_bands"][:pos] for r in rows], np.int64).reshape(len(rows), pos)
        starts = np.cumsum([0] + [len(r["l"]) for r in rows])
        distinct, ids = np.unique(np.frombuffer(b"".join(r["h"] for r in rows), np.uint64), return_inverse=True)
        w = np.exp(np.frombuffer(b"".join(r["l"] for r in rows), np.uint8) / STEPS)
        mass = np.add.reduceat(w, starts[:-1])
        own = np.zeros(len(distinct))
        for p in np.flatnonzero(left).tolist():
            # A pair of two strangers meets in two groups, and any pair in each band it shares:
            # it is tried once.
            mask = right & (label != label[p]) & (~stranger | (rank > rank[p])) & (np.minimum(mass, mass[p]) >= (threshold - 1e-9) * np.maximum(mass, mass[p]))
            if pos:
                mask &= ~(earlier == earlier[p]).any(1)
            at = np.flatnonzero(mask)
            if not len(at):
                continue
            sizes = starts[at + 1] - starts[at]
            ends = np.cumsum(sizes)
            where = np.arange(ends[-1]) + np.repeat(starts[at] - ends + sizes, sizes)
            mine = slice(starts[p], starts[p + 1])
            own[ids[mine]] = w[mine]
            common = np.add.reduceat(np.minimum(own[ids[where]], w[where]), ends - sizes)
            own[ids[mine]] = 0
            for m in at[common / (mass[p] + mass[at] - common) >= threshold - 1e-12].tolist():
                if label[m] != label[p]:
                    yield rows[p]["root"], rows[m]["root"]
                    label[label == label[m]] = label[p]

    def run(batches):
        now, rows = None, []
        for batch in batches:
            a, b = [], []
            for r in batch.to_pylist():
                if (r["bucket"], r["i"], r["j"]) != now:
                    for x, y in links(rows) if rows else ():
                        a.append(x)
                        b.append(y)
                    now, rows = (r["bucket"], r["i"], r["j"]), []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        if rows:
            found = list(links(rows))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

    return run


def _members(contents: DataFrame) -> DataFrame:
    """(key, _size, pos, bucket, n, c) of the contents in buckets of two and more: members of the
    bucket, and of all buckets of the content."""
    rows = contents.select("key", "_size", F.posexplode("_bands").alias("pos", "bucket"))
    # Written apart, so that a bucket with very many members is split at run time.
    sizes = checkpointed(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    return checkpointed(rows.join(sizes, "bucket").select("key", "_size", "pos", "bucket", "n", F.sum("n").over(Window.partitionBy("key")).alias("c")))


def _first_links(members: DataFrame) -> DataFrame:
    """(b, a): each content with the best hub of its buckets, if that isn't itself."""
    hubs = checkpointed(members.groupBy("bucket").agg(F.max(F.struct("c", "key")).alias("hub")))
    tried = members.join(hubs, "bucket").where("key <> hub.key").groupBy(F.col("key").alias("b")).agg(F.max("hub").alias("hub"))
    return checkpointed(tried.select("b", F.col("hub.key").alias("a")))


def _row_marks(keys: list[bytes | None], ids: np.ndarray) -> np.ndarray:
    """A hash of each row's content and id hash; rows without words: 0."""
    half = np.frombuffer(b"".join((k or bytes(8))[:8] for k in keys), np.uint64)
    return wordscan.mixed(half ^ wordscan.mixed(ids.view(np.uint64) + _U(1)))


def _wanted_bits(wanted: DataFrame) -> np.ndarray:
    """A table of ``2 ** WANTED_BITS`` bits in which those of the marks of (key, _h) are set.

    Its size is fixed: it only thins what is sent, and an exact join follows.
    """
    size = 1 << WANTED_BITS - 6

    def run(batches):
        table = np.zeros(size, np.uint64)
        for batch in batches:
            at = _row_marks(batch.column(0).to_pylist(), batch.column(1).to_numpy()) >> _U(64 - WANTED_BITS)
            np.bitwise_or.at(table, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        yield from parts.emitted(table.view(np.int64))

    return parts.merged(wanted.select("key", "_h").mapInArrow(run, parts.SCHEMA), size, np.bitwise_or).view(np.uint64)


def _shingled(docs: DataFrame, wanted: DataFrame, weigher) -> DataFrame:
    """(key, h, l): sorted shingle hashes and weight levels, as bytes, of the contents of
    ``wanted`` (key, _h), each read from the row of its least id."""
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(_wanted_bits(wanted))
    bound_batches(docs.sparkSession)

    def run(batches):
        own, table = weigher.value, bits.value
        for batch in batches:
            hashed = batch.column(1).to_numpy()
            for lo, hi, words in wordscan.scan(batch.column(0)):
                keys = content_keys(words, hi - lo)
                at = _row_marks(keys, hashed[lo:hi]) >> _U(64 - WANTED_BITS)
                here = [d for d in np.flatnonzero(table[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).tolist() if keys[d] is not None]
                if here:
                    texts = batch.column(0).slice(lo, hi - lo).take(pa.array(here))
                    h, t, level = own.weighted(wordscan.Words(*wordscan.text_buffers(texts)))
                    cut = np.searchsorted(t, np.arange(len(here) + 1)).tolist()
                    level = level.astype(np.uint8)
                    part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d in here], pa.binary()), pa.array(hashed[lo:hi][here]), part(h), part(level)], names=["key", "_h", "h", "l"])

    sent = docs.select("_text", F.xxhash64("_id").alias("_h")).mapInArrow(run, "key binary, _h long, h binary, l binary")
    found = sent.join(wanted, ["key", "_h"], "left_semi").dropDuplicates(["key", "_h"]).select("key", "h", "l")
    out = checkpointed(found)
    released(bits)
    return out


def _verified(links: DataFrame, shingled: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b) whose weighted Jaccard similarity reaches the threshold."""
    side = lambda x: shingled.select(F.col("key").alias(x), F.col("h").alias(f"h{x}"), F.col("l").alias(f"l{x}"))
    paired = links.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ha", "la", "hb", "lb")

    def check(batches):
        for batch in batches:
            keep = []
            for ha, la, hb, lb in zip(*(batch.column(i) for i in range(2, 6))):
                read = lambda h, l: (np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(l.as_buffer(), np.uint8))  # noqa: E731, E741
                keep.append(Weigher.similarity(*read(ha, la), *read(hb, lb)) >= threshold - 1e-12)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return paired.mapInArrow(check, "a binary, b binary")


def _remaining(members: DataFrame, first: DataFrame, classes: DataFrame, shingled: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """Links between roots: of all pairs that share a bucket and are in two classes, those whose
    similarity reaches the threshold.

    Every such pair has a *stranger*, one that isn't of the bucket's most frequent class.  The
    strangers and all members of a bucket are dealt into blocks of bounded size by a hash of their
    key, and each pair of blocks is a group of its own, so that a large bucket is spread over
    tasks and one with few strangers costs members times strangers.  A bucket of two whose pair
    was tried already is left out.
    """
    rows = members.join(classes, "key").join(first.withColumnRenamed("b", "key"), "key", "left").select("key", "root", "_size", "pos", "bucket", "a")
    pair = F.struct("key", "a")
    counts = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("_size").alias("w"), F.min(pair).alias("x"), F.max(pair).alias("y"))
    top = counts.groupBy("bucket").agg(F.max(F.struct("n", "root", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.min("x").alias("x"), F.max("y").alias("y")).where("n > top.n")
    tried = F.coalesce(F.col("x.a") == F.col("y.key"), F.lit(False)) | F.coalesce(F.col("y.a") == F.col("x.key"), F.lit(False))
    blocks = lambda n, w: F.ceil(F.greatest(n / F.lit(BLOCK_MEMBERS), w / F.lit(BLOCK_SHINGLES))).cast("int")
    # Written apart, so that a bucket with very many members is split at run time.
    mixed = checkpointed(top.where((F.col("n") > 2) | ~tried).select("bucket", F.col("top.root").alias("main"), blocks(F.col("n"), F.col("w")).alias("nb"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("sb")))
    own = F.xxhash64("key", "bucket")
    placed = rows.join(mixed, "bucket").select("bucket", "pos", "key", "root", "nb", "sb", F.pmod(own, "nb").cast("int").alias("o"), F.when(F.col("root") == F.col("main"), -1).otherwise(F.pmod(own, "sb")).cast("int").alias("s"))
    group = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("sb") - 1), lambda i: group(i, F.col("o")))
    as_stranger = F.when(F.col("s") >= 0, F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: group(F.col("s"), j))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    dealt = placed.select("bucket", "pos", "key", "root", "o", "s", F.explode(F.array_union(as_member, as_stranger)).alias("x")).select("bucket", "pos", "key", "root", "o", "s", "x.*")
    by = ["bucket", "i", "j"]
    described = shingled.join(contents.select("key", "_bands"), "key")
    found = dealt.join(described, "key").repartition(*by).sortWithinPartitions(*by).mapInArrow(_compared(threshold), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _merged(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes (key, root) after links between roots."""
    moved = connected_components(roots)
    return checkpointed(classes.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("key", F.coalesce("to", "root").alias("root")))


def _classes(docs: DataFrame, text_col: str, id_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(``_id, _key`` of every row; ``_key, class_id, _first, _least`` of every content)."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    weigher = context.broadcast(Weigher(*frequency_sketch(docs, "_text")))
    rows = checkpointed(map_batches(docs, [("_key", T.BinaryType()), ("_size", T.LongType()), ("_bands", T.ArrayType(T.LongType(), False))], _features(weigher, "_text", True), keep=["_id"]))
    contents = checkpointed(rows.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.min("_id").alias("_least"), F.first("_size").alias("_size"), F.first("_bands").alias("_bands")))
    members = _members(contents)
    shared = checkpointed(members.select("key").distinct())
    shingled = _shingled(docs, contents.join(shared, "key", "left_semi").select("key", F.xxhash64("_least").alias("_h")), weigher)
    released(weigher)
    first = _first_links(members)
    classes = _merged(shared.select("key", F.col("key").alias("root")), _verified(first, shingled, threshold))
    classes = _merged(classes, _remaining(members, first, classes, shingled, contents, threshold))
    rooted = contents.select("key", "_least").join(classes, "key", "left").select(F.col("key").alias("_key"), "_least", F.coalesce("root", "key").alias("root"))
    best = checkpointed(rooted.groupBy("root").agg(F.min("_least").alias("class_id"), F.min(F.struct(F.col("_least").isNull().alias("none"), "_least", "_key"))["_key"].alias("_best")))
    named = rooted.join(best, "root").select("_key", "class_id", (F.col("_key") == F.col("_best")).alias("_first"), "_least")
    # Both written apart, so that joins with a class of very many contents, or with very many
    # rows of one content, can be split at run time.
    return rows.select("_id", "_key"), checkpointed(named)


def near_classes(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: (id, ``_key``, ``class_id``, ``representative``).

    ``_key`` is the content digest, null without words; ``representative`` marks the rows of the
    class's least id with the content that has it.
    """
    rows, named = _classes(docs, text_col, id_col, threshold)
    return rows.join(named, "_key", "left").select(
        F.col("_id").alias(id_col),
        "_key",
        F.when(F.col("_key").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("_key").isNull() | (F.col("_first") & F.col("_id").eqNullSafe(F.col("_least")))).alias("representative"),
    )


def drop_near_copies(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class stays, that of the least id, and every row without words; columns as
    they came.

    Whole rows are shuffled once: those to stay are chosen on ids and digests alone.
    """
    names = docs.columns
    _, named = _classes(docs, text_col, id_col, threshold)
    stay = named.where("_first").select(F.xxhash64("_least", F.lit(0).cast("long")).alias("_stay_hash"), F.col("_key").alias("_stay_key"))
    own = set_aside(docs, ["_key", "_hash", "_alone", "_stay_hash", "_stay_key"])
    keyed = map_batches(own, [("_key", T.BinaryType())], _features(None, own.columns[names.index(text_col)], False))
    # Rows without words meet no partner, and are told apart by a number of their own.
    alone = F.when(F.col("_key").isNull(), F.monotonically_increasing_id())
    the_id = F.col(own.columns[names.index(id_col)])
    keyed = keyed.withColumn("_alone", alone).withColumn("_hash", F.xxhash64(the_id, F.coalesce("_alone", F.lit(0).cast("long"))))
    met = keyed.join(stay, (F.col("_hash") == F.col("_stay_hash")) & (F.col("_key") == F.col("_stay_key")), "left").where("_stay_key is not null or _key is null")
    once = met.dropDuplicates(["_hash", "_key", "_alone"])
    return once.select(*own.columns).toDF(*names)
