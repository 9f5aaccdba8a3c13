"""Connected components of a link table, by alternating large-star and small-star steps.

Everything stays in DataFrames: a step is one aggregation (combined map-side) and one equi-join,
each round is checkpointed reliably, and only two numbers a round reach the driver.  A node with
very many links meets aggregation before any join, and the join's skew is split at run time.
A table of few links, by count, is closed in one task instead, to the same result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpointed

#: Links that one task closes by union-find, a few MB; more are closed by distributed rounds.
ONE_TASK = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Written apart, so that both sides of the join are exchanges of their own, and a node with
    # very many links is split at run time.
    least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = checkpointed(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("b"), F.col("m").alias("a"))
    return moved.unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _closed(edges: DataFrame) -> DataFrame:
    """(b, a): every node but roots with its root, by union-find in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        arrow = None
        for batch in batches:
            arrow = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        if up:
            found = [(x, root(x)) for x in up]
            found = [(x, r) for x, r in found if x != r]
            yield pa.RecordBatch.from_arrays([pa.array([r for _, r in found], arrow), pa.array([x for x, _ in found], arrow)], names=["a", "b"])

    return edges.coalesce(1).mapInArrow(run, f"a {kind}, b {kind}")


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): for every node of the links ``a``-``b``, the least node of its component.

    Nodes may be of any orderable type.  Self-links and repeated links change nothing; links with
    a null end are ignored; an empty table gives an empty table.
    """
    edges = checkpointed(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = _mark(edges)
    for _ in range(max_rounds):
        if seen[0] <= one_task:
            # Also when rounds have shrunk the table to this: a round keeps the components.
            edges = checkpointed(_closed(edges))
            break
        edges = checkpointed(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
