"""Admission control: a token bucket, retries with backoff, and a replay of the bucket over
recorded arrivals."""

from __future__ import annotations

import math
import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QueueClosed(RuntimeError):
    """The queue takes no more work."""


class MaxRetriesExceeded(RuntimeError):
    """Every attempt failed; the last failure is the cause."""


@dataclass
class TokenBucket:
    """Starts full.  No sooner than a second after the last refill, it gains as many whole tokens
    as the time passed allows, up to its limit, and the clock starts anew.  ``second`` is a second
    in the clock's units; whole units are counted exactly."""

    limit: int
    last: float
    tokens: int = -1
    second: float = 1

    def __post_init__(self):
        self.limit = max(1, self.limit)
        if self.tokens < 0:
            self.tokens = self.limit

    def take(self, now: float) -> bool:
        passed = now - self.last
        if passed >= self.second:
            self.tokens = min(self.limit, self.tokens + math.floor(passed * self.limit // self.second))
            self.last = now
        if self.tokens:
            self.tokens -= 1
            return True
        return False


@dataclass
class AdmissionQueue:
    """Runs calls under a limit on those in flight, optionally on their rate, and retries them.

    The rate token is taken once, before the first attempt; retries don't take another.
    """

    concurrency: int = 4
    qps: int | None = None
    initial_delay_ms: int = 100
    max_delay_ms: int = 30_000
    jitter: float = 0.5
    max_retries: int = 3
    exponential: bool = True
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    draw: Callable[[int, int], int] = random.randint
    closed: bool = False
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __post_init__(self):
        in_flight = self.concurrency if self.qps is None else self.qps
        self._permits = threading.BoundedSemaphore(max(1, in_flight))
        self._bucket = None if self.qps is None else TokenBucket(self.qps, self.clock())

    @classmethod
    def with_concurrency_limit(cls, n: int, **options: Any) -> AdmissionQueue:
        return cls(concurrency=n, **options)

    @classmethod
    def with_qps_limit(cls, n: int, **options: Any) -> AdmissionQueue:
        return cls(qps=max(1, n), **options)

    def close(self) -> None:
        self.closed = True

    def __getstate__(self):
        raise TypeError("an admission queue belongs to one process")

    def _token(self) -> None:
        while self._bucket is not None:
            with self._lock:
                if self._bucket.take(self.clock()):
                    return
            self.sleep(0.1)

    def jittered(self, delay_ms: int) -> int:
        return delay_ms + (self.draw(0, int(delay_ms * self.jitter)) if self.jitter else 0)

    def with_retry(self, call: Callable[[], Any]) -> Any:
        if self.closed:
            raise QueueClosed
        with self._permits:
            self._token()
            delay = self.initial_delay_ms
            for attempt in range(self.max_retries + 1):
                try:
                    return call()
                except Exception as e:
                    if attempt == self.max_retries:
                        raise MaxRetriesExceeded(str(e)) from e
                    self.sleep(self.jittered(delay) / 1000)
                    if self.exponential:
                        delay = min(delay * 2, self.max_delay_ms)


def retry_delay(attempt: Column, *, initial_ms: int = 100, max_ms: int = 30_000) -> Column:
    """The delay before retry 0, 1, 2, ... without jitter, in milliseconds."""
    return F.least(F.lit(initial_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(40))), F.lit(float(max_ms))).cast("bigint")


def retry_jitter(delay: Column, factor: float = 0.5, seed: int | None = None) -> Column:
    """Whole milliseconds from 0 to the given share of the delay."""
    return F.floor(F.rand(seed) * (F.floor(delay * factor) + 1)).cast("bigint")


def replay_bucket(arrivals: DataFrame, limit: int, *, key: str, at: str, order: list[str]) -> DataFrame:
    """Which arrivals a bucket for each key would admit at once: columns ``admitted``, ``tokens``
    (left afterwards).

    A bucket is a sequential fold over its own arrivals.  Rows are dealt by key and sorted within
    partitions, and a task streams over them with the state of one bucket, so memory doesn't grow
    with a key's rows.  The time of the first arrival starts a bucket; null times are left out.
    """
    rows = arrivals.where(F.col(at).isNotNull()).withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    dealt = rows.repartition(key).sortWithinPartitions(key, "_at", *order)
    schema = T.StructType([*dealt.drop("_at").schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("tokens", T.LongType())])

    def run(batches):
        now, bucket, started = None, None, False
        for frame in batches:
            admitted, left = [], []
            for k, micros in zip(frame[key].tolist(), frame["_at"].tolist()):
                k = None if pd.isna(k) else k
                if not started or k != now:
                    now, started, bucket = k, True, TokenBucket(limit, micros, second=1_000_000)
                admitted.append(bucket.take(micros))
                left.append(bucket.tokens)
            yield frame.drop(columns="_at").assign(admitted=admitted, tokens=left)

    return dealt.mapInPandas(run, schema)
