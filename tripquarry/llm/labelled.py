"""What the two nearest-neighbour classifiers share: the bounded sample of labelled rows and the
calibration of votes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The documented bound: labelled rows that a model is fitted on, taken in the order of a hash of
#: the id, so that the choice doesn't depend on partitions.
MAX_LABELLED = 8000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2: labels of such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, text_col: str = "text", id_col: str = "doc_id", limit: int = MAX_LABELLED) -> DataFrame:
    """(text, label) of at most ``limit`` labelled rows that aren't held out; one row per text.

    Repeated label rows of an id, and repeated texts, are averaged and count as 1 from one half
    up; null labels and ids are left out.  Only the chosen ids (a bounded number) are broadcast.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "_id").groupBy("text").agg((F.avg("_label") >= 0.5).cast("int").alias("label"))


class Calibration:
    """Isotonic map from raw votes to probabilities, fitted by pooling adjacent violators."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, pseudo: float = 2.0):
        weights = np.ones(len(votes)) if weights is None else weights
        self.share = float((labels * weights).sum() + 0.5) / float(weights.sum() + 1)
        points: list[list[float]] = []
        at = np.round(votes, 4)
        for x in np.unique(at):
            w = weights[at == x]
            points.append([float(x), float(x), float((labels[at == x] * w).sum()), float(w.sum())])
            while len(points) > 1 and points[-2][2] * points[-1][3] >= points[-1][2] * points[-2][3]:
                b = points.pop()
                a = points[-1]
                points[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
        self.x = np.array([p for a in points for p in (a[0], a[1])] or [0.0])
        self.y = np.array([(a[2] + pseudo * self.share) / (a[3] + pseudo) for a in points for _ in (0, 1)] or [self.share])
        self.y = np.maximum.accumulate(self.y)

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(np.round(votes, 4), self.x, self.y), 0.0, 1.0)
