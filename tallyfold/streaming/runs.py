"""Streams over files: admission by quota, first sightings, counts by window."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyfold.functions.dates import micros
from tallyfold.operators.models import Model, called
from tallyfold.operators.quota import Ledger
from tallyfold.storage import new_folder


def opened(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """All that is there now, run through a stream with a checkpoint in the shared folder, and read back.

    path: a folder of an earlier run, which goes on where that one stopped; without it a fresh folder."""
    spark, path = stream.sparkSession, path or new_folder(stream.sparkSession, label)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def first_sightings(stream: DataFrame, key: str, at: str, late: str = "60 days") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is dropped behind it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, keys: list[str], size: str = "1 day", late: str = "60 days") -> DataFrame:
    """(keys, starts, n): counts by tumbling window; a window is given out once the watermark has passed its end."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("starts"), "n")


def admitted(stream: DataFrame, per_ip: int = 5, overall: int = 50) -> DataFrame:
    """(id, allowed, reason, remaining): the quota as keyed state of at most ``overall`` requests; in each micro-batch requests are
    decided in order of time and id. The single key serialises the decisions, as the global limit demands."""
    requests = stream.where("id is not null and created_at is not null").select("id", "ip_hash", micros(F.col("created_at").cast("timestamp_ntz")).alias("at"), F.lit(0).alias("everyone"))

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past: list[Any] = list(zip(*state.get)) if state.exists else []
        ledger = Ledger(per_ip, overall, past)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        got = [(i, *ledger.decide(at, ip)) for i, at, ip in zip(rows["id"], rows["at"], rows["ip_hash"])]
        state.update(([x[0] for x in ledger.admitted], [x[1] for x in ledger.admitted]))
        yield pd.DataFrame(got, columns=["id", "allowed", "reason", "remaining"])

    return requests.groupBy("everyone").applyInPandasWithState(step, "id long, allowed boolean, reason string, remaining int", "ats array<long>, ips array<string>", "append", GroupStateTimeout.NoTimeout)


def stamped(stream: DataFrame, key: str, model: Model, schema: str, label: str, batch: int = 10) -> DataFrame:
    """(key, *schema): replies of a model for the rows of a stream that have none yet, written batch by batch.

    Each micro-batch asks only for keys that the ledger lacks and appends what came back, so a run that breaks off
    goes on where it stopped and pays for no row twice."""
    spark, path = stream.sparkSession, new_folder(stream.sparkSession, label)
    names = [x.split()[0] for x in schema.split(", ")]
    empty = called(stream.sparkSession.createDataFrame([], stream.schema), key, model, schema, batch)
    empty.write.parquet(f"{path}/ledger")

    def step(rows: DataFrame, _: int) -> None:
        done = spark.read.schema(empty.schema).parquet(f"{path}/ledger").select(key)
        called(rows.dropDuplicates([key]).join(done, key, "left_anti"), key, model, schema, batch).write.mode("append").parquet(f"{path}/ledger")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(empty.schema).parquet(f"{path}/ledger").select(key, *names)
