"""Operator 3: toxicity by the nearest labelled examples, exact TF-IDF cosine.

Vectors hold all words of a bounded labelled sample; document frequencies of those words are
counted over all documents.  A word whose presence is associated with the label (chi-square over
the sample) counts in full, every other word ``BACKGROUND`` times that, so that examples are near
by what makes them toxic first and by the rest of their words after that.  One constant component
tells how much of a text is such words.

Labelled examples form a block-max inverted index, which is broadcast; its size is bounded by the
words of ``MAX_LABELLED`` texts.  Rare words are looked up in postings.  Words of many examples are
kept by blocks of examples with the largest weight of each word in a block: a block is visited
only if its bound reaches the cosine of the ``NEIGHBOURS``-th nearest example so far, so the result
is exact.  Neighbours vote with a weight that falls with distance; leave-one-out votes calibrate
the score.

Defined results: null text counts as empty; a text without sample words has the constant
component only; examples at the same distance as the last neighbour share its place; without
labelled examples the score is one half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import parts, wordscan
from .frames import aside, bound_batches, checkpointed, map_batches, released
from .labelled import MAX_LABELLED, Calibration, labelled_sample

NEIGHBOURS = 40
BLOCK = 64
CONSTANT = 4.0
BACKGROUND = 0.02
WIDTH = 0.03
BATCH = 128  # texts that are compared at a time
_MIN_DF = 5
_CHI = 30.0
_FREQUENT = 16  # a word of more than one in so many examples is kept by blocks


class Sparse:
    """Rows of (column, value), sorted by row and column."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.starts, self.columns, self.values = starts, columns, values

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def part(self, lo: int, hi: int) -> Sparse:
        a, b = self.starts[lo], self.starts[hi]
        return Sparse(self.starts[lo : hi + 1] - a, self.columns[a:b], self.values[a:b])


def _distinct(words: wordscan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text's begin, hash, count) of the distinct words of each text."""
    order = np.lexsort((words.hashes, words.texts))
    t, h = words.texts[order], words.hashes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return np.searchsorted(t[at], np.arange(len(words.of_text))), h[at], np.diff(np.append(at, len(t)))


class Vocabulary:
    """Sorted word hashes, and which of them are known."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def counts(self, words: wordscan.Words) -> Sparse:
        """Occurrences of each vocabulary word in each text."""
        starts, h, n = _distinct(words)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, h[maybe])
        hit = np.minimum(at, len(self.hashes) - 1) if len(self.hashes) else at
        same = self.hashes[hit] == h[maybe] if len(self.hashes) else np.zeros(0, bool)
        kept = maybe[same]
        return Sparse(np.searchsorted(kept, starts), at[same], n[kept].astype(np.float32))


class BlockMaxIndex:
    """Unit vectors of examples: postings of rare columns, blocks of frequent ones with the
    largest weight of each column in each block."""

    def __init__(self, vectors: Sparse, constant: np.ndarray, n_columns: int, block: int = BLOCK):
        self.n, self.block = len(vectors), block
        # Entries of like shape stand together, so that bounds are tight.
        self.order = np.lexsort((np.arange(self.n), -constant))
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        df = np.bincount(vectors.columns, minlength=n_columns)
        frequent = np.flatnonzero(df * _FREQUENT > self.n)
        self.dense_column = np.full(n_columns, -1)
        self.dense_column[frequent] = np.arange(1, len(frequent) + 1)
        rows, dense = place[vectors.rows], self.dense_column[vectors.columns]
        self.blocks = -(-self.n // block)
        self.dense = np.zeros((self.blocks * block, len(frequent) + 1), np.float32)
        self.dense[place, 0] = constant
        self.dense[rows[dense > 0], dense[dense > 0]] = vectors.values[dense > 0]
        self.most = self.dense.reshape(self.blocks, block, -1).max(1)
        rare = dense < 0
        by = np.lexsort((rows[rare], vectors.columns[rare]))
        self.entries, self.weights = rows[rare][by].astype(np.int32), vectors.values[rare][by]
        self.begin = np.searchsorted(vectors.columns[rare][by], np.arange(n_columns + 1))

    def _rare(self, queries: Sparse) -> np.ndarray:
        """The part of each cosine that rare columns make: queries x entries."""
        width, size = self.dense.shape[0], len(queries)
        rare = self.dense_column[queries.columns] < 0
        column, row, value = queries.columns[rare], queries.rows[rare], queries.values[rare]
        lengths = self.begin[column + 1] - self.begin[column]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return np.zeros((size, width), np.float32)
        at = np.arange(ends[-1]) + np.repeat(self.begin[column] - ends + lengths, lengths)
        return np.bincount(np.repeat(row * width, lengths) + self.entries[at], np.repeat(value, lengths) * self.weights[at], size * width).reshape(size, width).astype(np.float32)

    def cosines(self, queries: Sparse, constant: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosines of queries with all entries, by place, a bound that ``k`` entries reach);
        entries below the bound may hold -1 instead."""
        rare = self._rare(queries)
        q = np.zeros((len(queries), self.dense.shape[1]), np.float32)
        q[:, 0] = constant
        dense = self.dense_column[queries.columns]
        q[queries.rows[dense > 0], dense[dense > 0]] = queries.values[dense > 0]
        bound = q @ self.most.T + rare.reshape(len(queries), self.blocks, self.block).max(2)
        out = np.full(rare.shape, -1, np.float32)

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)).tolist():
                span, which = slice(b * self.block, (b + 1) * self.block), np.flatnonzero(wanted[:, b])
                out[which, span] = q[which] @ self.dense[span].T + rare[which, span]
            out[:, self.n :] = -1

        first = min(self.blocks, 2 + k // self.block)
        which = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        best = np.zeros(bound.shape, bool)
        np.put_along_axis(best, which, True, axis=1)
        visit(best)
        near = np.take_along_axis(out.reshape(len(out), self.blocks, self.block), which[:, :, None], 1).reshape(len(out), -1)
        kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        visit(~best & (bound >= kth[:, None] - 1e-5))
        return out, kth


class ToxicityModel:
    """Vocabulary, weights, index, labels and calibration; picklable."""

    def __init__(self, hashes: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, frequencies, *, neighbours: int = NEIGHBOURS, width: float = WIDTH, constant: float = CONSTANT, background: float = BACKGROUND):
        """``hashes`` and ``counts`` of the words of each example, sorted by hash;
        ``frequencies(vocabulary)`` gives (documents with each word, documents)."""
        self.k, self.width, self.constant = min(neighbours, max(len(labels) - 1, 1)), width, constant
        self.vocabulary = Vocabulary(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        self.df, self.documents = frequencies(self.vocabulary)
        self.labels, self.index = labels, None
        size = len(self.vocabulary.hashes)
        starts = np.concatenate(([0], np.cumsum([len(h) for h in hashes]))).astype(np.int64)
        sample = Sparse(starts, np.searchsorted(self.vocabulary.hashes, np.concatenate([np.zeros(0, np.uint64), *hashes])), np.concatenate([np.zeros(0, np.float32), *counts]).astype(np.float32))
        self.telling = self._associated(sample, labels, size)
        idf = np.log((1 + self.documents) / (1 + self.df)) + 1
        scale = idf[self.telling].mean() if self.telling.any() else 1.0
        self.weight = (idf / scale * np.where(self.telling, 1.0, background)).astype(np.float32)
        if len(labels) < 2:
            return
        vectors, own = self._unit(sample)
        self.index = BlockMaxIndex(vectors, own, size)
        self.by_place = np.concatenate((labels[self.index.order], np.zeros(len(self.index.dense) - len(labels))))
        votes = np.concatenate([self._votes(vectors, own, lo, True)[0] for lo in range(0, len(vectors), BATCH)])
        self.calibrate = Calibration(votes, labels)

    @staticmethod
    def _associated(sample: Sparse, labels: np.ndarray, size: int) -> np.ndarray:
        """Words positively associated with the label, by chi-square of presence."""
        n, p = float(len(labels)), float(labels.sum())
        if p in (0.0, n):
            return np.zeros(size, bool)
        c = np.bincount(sample.columns, minlength=size).astype(float)
        a = np.bincount(sample.columns, labels[sample.rows], size)
        chi = n * (a * (n - p) - (c - a) * p) ** 2 / np.maximum(p * (n - p) * c * (n - c), 1e-9)
        return (a >= _MIN_DF) & (c < n) & (a * n > c * p) & (chi >= _CHI)

    def _unit(self, counts: Sparse) -> tuple[Sparse, np.ndarray]:
        """(vectors of unit length, their constant component)."""
        values = counts.values * self.weight[counts.columns]
        norm = np.sqrt(np.bincount(counts.rows, values.astype(np.float64) ** 2, len(counts)) + self.constant**2)
        return Sparse(counts.starts, counts.columns, (values / norm[counts.rows]).astype(np.float32)), (self.constant / norm).astype(np.float32)

    def _votes(self, vectors: Sparse, own: np.ndarray, lo: int, leave_out: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch of texts from ``lo`` on: share of positive votes, and row, label and cosine
        of the neighbours, nearest first.  ``leave_out``: the texts are the examples."""
        hi = min(len(vectors), lo + BATCH)
        cos, bound = self.index.cosines(vectors.part(lo, hi), own[lo:hi], self.k + leave_out)
        if leave_out:
            place = np.empty(self.index.n, np.int64)
            place[self.index.order] = np.arange(self.index.n)
            cos[np.arange(hi - lo), place[lo:hi]] = -1
        row, place = np.nonzero((cos >= bound[:, None] - 1e-5) & (cos > -1))
        c = np.minimum(cos[row, place], 1.0).astype(np.float64)
        order = np.lexsort((place, -c, row))
        row, place, c = row[order], place[order], c[order]
        n = hi - lo
        begin = np.searchsorted(row, np.arange(n + 1))
        last = c[np.minimum(begin[:-1] + self.k, begin[1:]) - 1][row]
        stay, above = c >= last - 1e-6, c > last + 1e-6
        over, tied = np.bincount(row, above, n), np.bincount(row, stay & ~above, n)
        share = np.where(above, 1.0, ((self.k - over) / np.maximum(tied, 1))[row])
        weight = np.where(stay, np.exp((c - 1) / self.width) * share, 0.0)
        label = self.by_place[place]
        return np.bincount(row, weight * label, n) / np.maximum(np.bincount(row, weight, n), 1e-300), row, label, c

    def score(self, counts: Sparse) -> tuple[np.ndarray, list[list[dict]]]:
        """(scores, the nearest three examples as evidence) of texts by their word counts."""
        if self.index is None:
            return np.full(len(counts), 0.5), [[] for _ in range(len(counts))]
        vectors, own = self._unit(counts)
        raw, near = [np.zeros(0)], []
        for lo in range(0, len(vectors), BATCH):
            votes, row, label, c = self._votes(vectors, own, lo)
            raw.append(votes)
            begin = np.searchsorted(row, np.arange(len(votes) + 1))
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                near.append([{"cosine": x, "toxic": int(y)} for x, y in zip(c[a : min(b, a + 3)].tolist(), label[a : min(b, a + 3)].tolist())])
        return self.calibrate(np.concatenate(raw)), near


def vocabulary_frequencies(docs: DataFrame, vocabulary: Vocabulary, text_col: str) -> tuple[np.ndarray, int]:
    """Documents with each vocabulary word, and documents, over all rows."""
    spark = docs.sparkSession
    bound_batches(spark)
    size, shared = len(vocabulary.hashes), spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        total = np.zeros(parts.padded(size + 1), np.int64)
        for batch in batches:
            for lo, hi, words in wordscan.scan(batch.column(0)):
                np.add.at(total, shared.value.counts(words).columns, 1)
                total[size] += hi - lo
        yield from parts.emitted(total)

    total = parts.merged(docs.select(text_col).mapInArrow(run, parts.SCHEMA), size + 1)
    released(shared)
    return total[:size], int(total[size])


def _sample_words(sample: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(word hashes, counts, label) of every example, in an order that doesn't depend on
    partitions; the sample is bounded."""
    bound_batches(sample.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi, words in wordscan.scan(batch.column(0)):
                starts, h, n = _distinct(words)
                cut = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([h[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([n[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary()), batch.column(1).slice(lo, hi - lo)], names=["h", "n", "label"])

    rows = sorted((bytes(r["h"]), bytes(r["n"]), r["label"]) for r in sample.select("text", "label").mapInArrow(run, "h binary, n binary, label int").toLocalIterator())
    return [np.frombuffer(r[0], np.uint64) for r in rows], [np.frombuffer(r[1], np.int32) for r in rows], np.array([r[2] for r in rows], float)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED, **options) -> ToxicityModel:
    """Fit on at most ``max_labelled`` labelled rows that aren't held out."""
    sample = checkpointed(labelled_sample(docs, labels, label_col, text_col=text_col, id_col=id_col, limit=max_labelled))
    return ToxicityModel(*_sample_words(sample), lambda vocabulary: vocabulary_frequencies(docs, vocabulary, text_col), **options)


_NEAR = [("cosine", pa.float64()), ("toxic", pa.int64())]
_EVIDENCE = T.ArrayType(T.StructType([T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.LongType())]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Add ``score``, ``predicted``, and as evidence ``terms`` (the text's words that are
    associated with the label, in order) and ``neighbours`` (cosine and label of the three nearest
    examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs, keep = aside(docs, [c for c in ("score", "predicted", "terms", "neighbours") if c != text_col], keep)

    def make():
        own: ToxicityModel = shared.value
        telling = own.vocabulary.hashes[own.telling]

        def work(batch: pa.RecordBatch):
            for lo, hi, words in wordscan.scan(batch.column(text_col)):
                scores, near = own.score(own.vocabulary.counts(words))
                terms: list[set] = [set() for _ in range(hi - lo)]
                texts = words.texts
                for i in np.flatnonzero(np.isin(words.hashes, telling)).tolist():
                    terms[texts[i]].add(words.word(i).decode())
                yield lo, hi, {"score": pa.array(scores), "terms": pa.array([sorted(t) for t in terms], pa.list_(pa.string())), "neighbours": pa.array(near, pa.list_(pa.struct(_NEAR)))}

        return work

    out = map_batches(docs, [("score", T.DoubleType()), ("terms", T.ArrayType(T.StringType())), ("neighbours", _EVIDENCE)], make, keep)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
