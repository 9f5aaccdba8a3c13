"""Operator 2: quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are of two kinds: words, hashed to ``WORDS`` columns, and the shape of the text (trigrams of
byte classes: case, digits, each kind of punctuation; marks of words that recur at a short
distance; the text's order of length).  Either kind is scaled to a length of its own, words to
``WORD_WEIGHT`` of the shape's.  Terms never hold a label, language, source or id.  Document
frequencies are counted over all documents.  A bounded sample of labelled documents gives the
latent space (randomised SVD of its TF-IDF matrix, in numpy on the driver, block by block) and the
labelled vectors; both are broadcast, and their size is fixed by ``MAX_LABELLED``, ``RANK`` and the
number of terms.  Every document is projected, its exact cosines to all labelled
vectors are computed block by block, and the labels of the nearest vote, weighted by similarity.
Leave-one-out votes of the labelled documents calibrate the score.

Defined results: null text counts as empty; an empty text has its length term only; ties at the
last neighbour all vote; without labelled documents the score is one half; repeated rows score
alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordscan
from .frames import aside, bound_batches, map_batches
from .labelled import MAX_LABELLED, Calibration, held_out, labelled_sample

RANK = 64
NEIGHBOURS = 24
SHARPNESS = 8.0
_CLASSES = 20
_GAPS = (1, 2, 3, 4)
_LENGTHS = 24
SHAPES = _CLASSES**3 + len(_GAPS) + _LENGTHS
WORDS, WORD_WEIGHT = 1 << 12, 0.5
TERMS = SHAPES + WORDS
_ROWS = 256


def _byte_classes() -> np.ndarray:
    """0 other, 1 lower, 2 upper, 3 digit, 4 non-ASCII, 5 blank, 6 newline, then one each."""
    kinds = np.zeros(256, np.int32)
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 1, 2, 3, 4
    kinds[[9, 11, 12, 32]], kinds[[10, 13]] = 5, 6
    for i, c in enumerate(b".,!?|#*$%&<>'"):
        kinds[c] = 7 + i
    return kinds


_KIND = _byte_classes()


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of term counts for each text (dense; a slice holds few texts)."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    kinds = _KIND[data]
    grams = (kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:] if len(kinds) > 2 else np.zeros(0, np.int32)
    words = wordscan.Words(data, offsets)
    h, texts = words.hashes, words.texts
    for i, gap in enumerate(_GAPS):
        same = texts[gap:][(h[gap:] == h[:-gap]) & (texts[gap:] == texts[:-gap])]
        out[:, _CLASSES**3 + i] = np.bincount(same, minlength=n)
    lengths = np.diff(offsets)
    for d in range(n):
        part = grams[offsets[d] : max(offsets[d], offsets[d + 1] - 2)]
        if len(part):
            out[d, : _CLASSES**3] = np.bincount(part, minlength=_CLASSES**3)
    out[np.arange(n), _CLASSES**3 + len(_GAPS) + np.minimum(np.log2(lengths + 1).astype(int), _LENGTHS - 1)] = 1
    np.add.at(out, (texts, SHAPES + (h % np.uint64(WORDS)).astype(np.int64)), 1)
    return out


def _row_slices(column: pa.Array):
    data, offsets = wordscan.text_buffers(column)
    for lo, hi in wordscan.slices(offsets):
        for a in range(lo, hi, _ROWS):
            b = min(hi, a + _ROWS)
            yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents with each term, documents), over all rows; what reaches the driver is one
    number per term."""
    bound_batches(docs.sparkSession)

    def run(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for a, b, data, offsets in _row_slices(batch.column(0)):
                total += (term_counts(data, offsets) > 0).sum(0)
                n += b - a
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["term", "df"])

    counted = docs.select(text_col).mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(TERMS, np.int64), 0
    for r in counted:
        if r["term"] < 0:
            n = r["df"]
        else:
            df[r["term"]] = r["df"]
    return df, n


def _sparse_sample(sample: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """((terms, counts) of each text, labels) of the labelled sample, which is bounded, on the
    driver, in an order that doesn't depend on partitions."""
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in _row_slices(batch.column(0)):
                counts = term_counts(data, offsets)
                at = [np.flatnonzero(row) for row in counts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.astype(np.int32).tobytes() for x in at], pa.binary()), pa.array([r[x].tobytes() for r, x in zip(counts, at)], pa.binary()), batch.column(1).slice(a, b - a)],
                    names=["at", "n", "label"],
                )

    bound_batches(sample.sparkSession)
    rows = sorted((bytes(r["at"]), bytes(r["n"]), r["label"]) for r in sample.mapInArrow(run, "at binary, n binary, label int").toLocalIterator())
    return [(np.frombuffer(at, np.int32), np.frombuffer(n, np.float32)) for at, n, _ in rows], np.array([label for _, _, label in rows], np.float64)


class LatentVotes:
    """Projection, labelled vectors and calibration; picklable."""

    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, df: np.ndarray, n: int, *, rank: int = RANK, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS):
        """``sample``: (terms, counts) of each labelled text."""
        self.neighbours, self.sharpness, self.labels = neighbours, sharpness, labels
        used = np.zeros(TERMS, bool)
        for at, _ in sample:
            used[at] = True
        self.terms = np.flatnonzero(used)
        self.idf = (np.log((1 + n) / (1 + df[self.terms])) + 1).astype(np.float32)
        self.project = self._right_vectors(sample, min(rank, len(sample), len(self.terms))) if len(self.terms) else np.zeros((0, 1), np.float32)
        self.vectors = _unit(np.concatenate([np.zeros((0, self.project.shape[1]), np.float32), *(x @ self.project for x in self._blocks(sample))]))
        self.calibrate = Calibration(self._votes(self.vectors, True), labels) if len(labels) > 1 else None

    def _blocks(self, sample: list[tuple[np.ndarray, np.ndarray]]):
        """The weighted matrix of the sample, some rows at a time."""
        for lo in range(0, len(sample), _ROWS):
            part = sample[lo : lo + _ROWS]
            counts = np.zeros((len(part), TERMS), np.float32)
            for row, (at, n) in zip(counts, part):
                row[at] = n
            yield self._weighted(counts)

    def _right_vectors(self, sample: list[tuple[np.ndarray, np.ndarray]], rank: int) -> np.ndarray:
        """Leading right singular vectors by randomised subspace iteration."""
        width = min(rank + 12, len(sample), len(self.terms))
        q = np.random.default_rng(7).standard_normal((len(self.terms), width)).astype(np.float32)
        for _ in range(5):
            q, _ = np.linalg.qr(sum(x.T @ (x @ q) for x in self._blocks(sample)))
        # With b = x q, the right singular vectors of b are the eigenvectors of its Gram matrix.
        _, right = np.linalg.eigh(sum((x @ q).T @ (x @ q) for x in self._blocks(sample)))
        return (q @ right[:, ::-1][:, :rank]).astype(np.float32)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        """Square root of the share of each term in its kind, times its inverse document
        frequency."""
        x = np.sqrt(counts[:, self.terms]) * self.idf
        split = int(np.searchsorted(self.terms, SHAPES))
        x[:, :split] = _unit(x[:, :split])
        x[:, split:] = WORD_WEIGHT * _unit(x[:, split:])
        return _unit(x)

    def _votes(self, q: np.ndarray, leave_out: bool = False, block: int = 256) -> np.ndarray:
        out = np.empty(len(q))
        for lo in range(0, len(q), block):
            cos = q[lo : lo + block] @ self.vectors.T
            if leave_out:
                own = np.arange(lo, lo + len(cos))
                cos[own - lo, own] = -1
            k = min(self.neighbours, cos.shape[1])
            last = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
            weight = np.where(cos >= last[:, None] - 1e-6, np.maximum(cos, 1e-3).astype(np.float64) ** self.sharpness, 0)
            out[lo : lo + block] = (weight @ self.labels) / weight.sum(1)
        return out

    def score(self, counts: np.ndarray) -> np.ndarray:
        if self.calibrate is None:
            return np.full(len(counts), 0.5)
        return self.calibrate(self._votes(_unit(self._weighted(counts) @ self.project)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED, **options) -> LatentVotes:
    """Fit on at most ``max_labelled`` labelled rows that aren't held out; frequencies are of all
    rows of ``docs``."""
    counts, y = _sparse_sample(labelled_sample(docs, labels, label_col, text_col=text_col, id_col=id_col, limit=max_labelled))
    df, n = document_frequencies(docs, text_col)
    return LatentVotes(counts, y, df, n, **options)


def score_quality(docs: DataFrame, model: LatentVotes, *, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs, keep = aside(docs, [c for c in ("score", "predicted") if c != text_col], keep)

    def make():
        own: LatentVotes = shared.value

        def work(batch: pa.RecordBatch):
            for a, b, data, offsets in _row_slices(batch.column(text_col)):
                yield a, b, {"score": pa.array(own.score(term_counts(data, offsets)))}

        return work

    out = map_batches(docs, [("score", T.DoubleType())], make, keep)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


__all__ = ["LatentVotes", "fit_quality", "held_out", "score_quality"]
