"""Token bucket, retries and the replay."""

import datetime

import pytest
from pyspark.sql import functions as F

from tripquarry.operators import admission
from tripquarry.operators.admission import AdmissionQueue, MaxRetriesExceeded, QueueClosed, TokenBucket


def test_bucket_refills_whole_tokens_after_a_second():
    b = TokenBucket(2, 0.0)
    assert [b.take(t) for t in (0, 0.1, 0.2, 0.9)] == [True, True, False, False]
    assert [b.take(t) for t in (1.4, 1.5, 1.6, 2.3)] == [True, True, False, False]
    assert b.take(2.4)  # a second after the last refill


def test_retries_and_delays():
    slept, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("no")

    q = AdmissionQueue(sleep=slept.append, jitter=0)
    with pytest.raises(MaxRetriesExceeded):
        q.with_retry(fail)
    assert len(calls) == 4 and slept == [0.1, 0.2, 0.4]
    assert q.with_retry(lambda: 7) == 7
    q.close()
    with pytest.raises(QueueClosed):
        q.with_retry(lambda: 7)


def test_jitter_bounds_and_rate():
    q = AdmissionQueue(draw=lambda a, b: b)
    assert q.jittered(100) == 150
    now = [0.0]
    q = AdmissionQueue.with_qps_limit(2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        q.with_retry(lambda: None)
    assert now[0] >= 1


def test_replay_matches_a_loop(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, "a" if i % 3 else None, start + datetime.timedelta(milliseconds=217 * i)) for i in range(60)]
    got = {r["i"]: r["admitted"] for r in admission.replay_bucket(spark.createDataFrame(rows, "i int, k string, t timestamp"), 2, key="k", at="t", order=["i"]).collect()}
    buckets = {}
    for i, k, t in rows:
        s = (t - start).total_seconds()
        assert got[i] == buckets.setdefault(k, TokenBucket(2, s)).take(s)


def test_replay_of_nothing(spark):
    assert admission.replay_bucket(spark.createDataFrame([], "i int, k string, t timestamp"), 2, key="k", at="t", order=["i"]).count() == 0


def test_schedule(spark):
    got = [r["d"] for r in spark.range(11).select(admission.retry_delay(F.col("id")).alias("d")).collect()]
    assert got[:4] == [100, 200, 400, 800] and got[-1] == 30000
