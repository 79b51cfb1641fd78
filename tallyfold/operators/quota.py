"""Rolling counts and admission by quota."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.dates import micros

HOUR = 3_600_000_000
DAY = 24 * HOUR


def rolling(log: DataFrame, keys: list[str], name: str, span: int = DAY, bucket: int = HOUR) -> DataFrame:
    """Each row of ``log`` (id, at in microseconds, keys) with the number of rows of its keys in the span that ends with it,
    the span's start excluded.

    A row adds one at its time and takes one away a span later; the count is the running sum. Sums run inside buckets
    of time, on top of the sum of all earlier buckets, so neither a hot key nor the global count is one task's work."""
    plus = log.select("id", "at", *keys, F.lit(1).alias("d"))
    minus = log.select(F.lit(None).cast("long").alias("id"), (F.col("at") + span).alias("at"), *keys, F.lit(-1).alias("d"))
    steps = plus.unionByName(minus).withColumn("bucket", F.floor(F.col("at") / bucket))
    sums = steps.groupBy(*keys, "bucket").agg(F.sum("d").alias("s"))
    earlier = F.sum("s").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("s")  # a row an hour
    before = sums.select(*keys, "bucket", earlier.alias("before"))
    inside = F.sum("d").over(Window.partitionBy(*keys, "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("inside", inside).where("id is not null").join(before, [*keys, "bucket"]).select("id", *keys, (F.col("before") + F.col("inside")).alias(name))


def timed(log: DataFrame) -> DataFrame:
    """(id, ip_hash, at) of a log with ``created_at``; rows without id or time are left out."""
    return log.where("id is not null and created_at is not null").select("id", "ip_hash", micros(F.col("created_at").cast("timestamp_ntz")).alias("at"))


def peek(log: DataFrame, now: int, limit: int = 5) -> DataFrame:
    """(ip_hash, used, remaining) within the day before ``now``, its start excluded."""
    recent = log.where((F.col("at") > now - DAY) & (F.col("at") <= now))
    used = recent.groupBy("ip_hash").agg(F.count("*").alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(limit).cast("long") - F.col("used"), F.lit(0).cast("long")))


class Ledger:
    """The admitted requests of the last day, in order: all that a decision depends on."""

    def __init__(self, per_ip: int, overall: int, past: list[tuple[int, str]] = ()):
        self.per_ip, self.overall, self.admitted = per_ip, overall, deque(past)

    def decide(self, at: int, ip: str) -> tuple[bool, str | None, int]:
        """(allowed, reason, remaining). Only admitted requests count, so the order of requests matters."""
        while self.admitted and self.admitted[0][0] <= at - DAY:
            self.admitted.popleft()
        if len(self.admitted) >= self.overall:
            return False, "global", 0
        used = sum(1 for _, x in self.admitted if x == ip)
        if used >= self.per_ip:
            return False, "ip", 0
        self.admitted.append((at, ip))
        return True, None, self.per_ip - used - 1


def admissions(log: DataFrame, per_ip: int = 5, overall: int = 50) -> DataFrame:
    """(id, allowed, reason, remaining) of requests in order of (at, id).

    Every decision depends on all before it through the global limit, so they are taken one after the other: the
    rows are sorted by Spark and stream through one task that holds no more than ``overall`` admitted requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger = Ledger(per_ip, overall)
        for b in batches:
            got = [ledger.decide(at, ip) for at, ip in zip(b.column("at").to_pylist(), b.column("ip_hash").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32())], ["id", "allowed", "reason", "remaining"])

    return log.select("id", "ip_hash", "at").repartition(1).sortWithinPartitions("at", "id").mapInArrow(run, "id long, allowed boolean, reason string, remaining int")
