"""Filling fixed-capacity containers with documents (problem 7), balanced by cost.

The cost of a document of n tokens in a container is n + QUADRATIC * n * n: what its tokens cost in the linear layers and
what they cost in attention over the document. A document longer than a container is cut into full containers
and a rest, no other is split. In descending order each piece goes to the container with the lowest cost among
those with room for it; a container is opened only when none has room, beginning with as many as the
tokens need at least. So costs stay even while small pieces fill what large ones leave.

Documents are dealt to shards by a hash of their key, about SHARD documents each, and every shard packs its own
containers, so the work is spread however many documents there are and a shard's memory is bounded. A shard
leaves at most about one container unfilled. Hot sources or repeated texts don't matter: only sizes count.

Documents without tokens need no container and give no row. Ties (equal size, equal cost) go to the smaller
key and the earlier container. Capacities that are null or below one give no row. Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 8192
QUADRATIC = 1 / 4096  # attention costs as much as the rest at documents of 4096 tokens


def pieces_of(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of so many tokens."""
    count = -(-size // capacity)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * capacity
    return doc, start, np.minimum(size[doc] - start, capacity)


def pack(length: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece; pieces come in descending order of length."""
    full = int((length == capacity).sum())
    out = np.empty(len(length), np.int64)
    out[:full] = np.arange(full)  # they leave no room
    rest = length[full:]
    n = int(-(-rest.sum() // capacity))
    room = np.full(max(16, 2 * n), capacity, np.int64)
    cost = np.zeros(len(room))
    for i, size in enumerate(rest):
        fits = np.flatnonzero(room[:n] >= size)
        if len(fits):
            at = fits[np.argmin(cost[fits])]
        else:
            at, n = n, n + 1
            if n > len(room):
                room, cost = np.append(room, np.full(n, capacity)), np.append(cost, np.zeros(n))
        room[at] -= size
        cost[at] += size + QUADRATIC * size * size
        out[full + i] = full + at
    return out


def packed(sizes: DataFrame, limits: DataFrame, key: str = "key", size: str = "n_tokens") -> DataFrame:
    """(limit_id, shard, container, key, start_token, n_tokens): where every piece of every document lies.

    limits: (limit_id, capacity_tokens), a short list; (limit_id, shard, container) names a container."""
    caps = [(int(r["limit_id"]), int(r["capacity_tokens"])) for r in limits.where("limit_id is not null and capacity_tokens >= 1").distinct().collect()]
    schema = "limit_id long, shard int, container long, key long, start_token long, n_tokens long"
    docs = sizes.select(F.col(key).cast("long").alias("key"), F.col(size).cast("long").alias("n")).where("key is not null and n > 0")
    spark = sizes.sparkSession
    if not caps:
        return spark.createDataFrame([], schema)
    shards = max(1, -(-docs.count() // SHARD))
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for i, c in caps])).alias("x")
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).select("key", "n", "shard", each).select("key", "n", "shard", "x.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        keys, n, shard, limit, cap = (t.column(c).to_numpy() for c in ("key", "n", "shard", "limit_id", "capacity"))
        group = np.lexsort((keys, -n, shard, limit))
        edges = np.flatnonzero(np.diff(limit[group]) | np.diff(shard[group])) + 1
        for g in np.split(group, edges):
            capacity = int(cap[g[0]])
            doc, start, length = pieces_of(n[g], capacity)
            order = np.lexsort((start, keys[g][doc], -length))
            container = pack(length[order], capacity)
            doc, m = g[doc[order]], len(order)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, limit[g[0]])), pa.array(np.full(m, shard[g[0]], np.int32)), pa.array(container), pa.array(keys[doc]), pa.array(start[order]), pa.array(length[order])], ["limit_id", "shard", "container", "key", "start_token", "n_tokens"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards * len(caps) // 4)
    return dealt.repartition(parts, "limit_id", "shard").mapInArrow(run, schema)


def fill(packing: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, capacity_tokens, containers, tokens, fill, cost_spread): how well each capacity is used.
    cost_spread: the standard deviation of the containers' costs over their mean."""
    cost = packing.groupBy("limit_id", "shard", "container").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") + QUADRATIC * F.col("n_tokens") * F.col("n_tokens")).alias("cost"))
    total = cost.groupBy("limit_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"))
    return total.join(limits.select("limit_id", "capacity_tokens").distinct(), "limit_id").select("limit_id", "capacity_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"), "cost_spread")
