import numpy as np
import pytest

from tripquarry.llm import parts


@pytest.mark.parametrize("merge", [np.add, np.bitwise_or])
def test_one_table_in_few_jobs_however_many_partitions(spark, merge):
    size = 5 * parts.PART + 7
    tables = [np.where(np.arange(parts.padded(size)) % (k + 2), 0, k + 1).astype(np.int64) for k in range(6)]

    def emit(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from parts.emitted(tables[k])

    rows = spark.range(6).repartition(6, "id").mapInArrow(emit, parts.SCHEMA)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup(f"parts-{merge.__name__}", "merged tables")
        got = parts.merged(rows, size, merge)
        jobs = len(context.statusTracker().getJobIdsForGroup(f"parts-{merge.__name__}"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for k in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(k, None)
    assert (got == merge.reduce(tables)[:size]).all() and 0 < jobs <= 4, jobs


def test_a_large_table_goes_by_partition_to_the_same_result(spark, monkeypatch):
    def emit(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from parts.emitted(np.full(3 * parts.PART, k + 1, np.int64))

    rows = spark.range(3).mapInArrow(emit, parts.SCHEMA)
    monkeypatch.setattr(parts, "AT_ONCE", 0)
    assert (parts.merged(rows, 3 * parts.PART - 5) == np.full(3 * parts.PART - 5, 6)).all()


def test_no_rows_are_zeros(spark):
    assert not parts.merged(spark.createDataFrame([], parts.SCHEMA), 10).any()
