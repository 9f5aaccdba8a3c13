"""Small helpers that the operators share: names, Arrow batch size, reliable checkpoints."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of one Arrow batch that the JVM sends to a Python worker.  A batch holds one row at
#: least, so a worker's memory follows this figure or the longest single text.
ARROW_BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, limit: int = ARROW_BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, so that long texts never meet in one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(str(spark.conf.get(key)).rstrip("bB"))
    except ValueError:
        now = -1
    if not 0 < now <= limit:
        spark.conf.set(key, str(limit))


def set_aside(df: DataFrame, own: list[str]) -> DataFrame:
    """Rename input columns whose names an operator is about to add: ``x`` becomes ``x_in``.

    Names are compared without case, as Spark does; ``_in`` is added until the name is free.
    """
    taken = {c.lower() for c in df.columns} | {c.lower() for c in own}
    wanted = {c.lower() for c in own}
    names = []
    for c in df.columns:
        if c.lower() in wanted:
            new = f"{c}_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            names.append(new)
        else:
            names.append(c)
    return df if names == df.columns else df.toDF(*names)


def aside(df: DataFrame, own: list[str], keep: list[str] | None) -> tuple[DataFrame, list[str]]:
    """``set_aside``, and the names that the columns of ``keep`` (None: all) have after it."""
    out = set_aside(df, own)
    return out, [new for old, new in zip(df.columns, out.columns) if keep is None or old in keep]


def released(*shared) -> None:
    """Take broadcasts off the executors once what needed them is written."""
    for broadcast in shared:
        broadcast.unpersist(blocking=False)


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written between steps, which all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset on one machine (tests)
    is it a folder under the warehouse; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, add: list[tuple[str, T.DataType]], make, keep: list[str] | None = None) -> DataFrame:
    """Add columns computed in Python from Arrow batches; the columns of ``keep`` pass through.

    ``make()`` runs once in each task and returns ``f(batch) -> iterator of (lo, hi, {name:
    array})`` for consecutive slices ``[lo, hi)`` that cover the batch.
    """
    bound_batches(df.sparkSession)
    kept = df.columns if keep is None else keep
    fields = [f for f in df.schema.fields if f.name in kept] + [T.StructField(n, t) for n, t in add]
    order = [f.name for f in fields]

    def run(batches):
        work = make()
        for batch in batches:
            for lo, hi, new in work(batch):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(n) for n in order], names=order)

    return df.mapInArrow(run, T.StructType(fields))
