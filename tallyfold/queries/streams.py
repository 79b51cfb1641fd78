"""Structured Streaming runs over the tables' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import models
from tallyfold.queries.registry import LISTINGS, query
from tallyfold.queries.retrieval import ADMITTED
from tallyfold.storage import table
from tallyfold.streaming import runs


@query(f"SELECT DISTINCT id FROM {LISTINGS} WHERE id IS NOT NULL")
def stream_first_sightings(spark: SparkSession, d: str) -> DataFrame:
    """Each id once, whenever its first row arrives: the whole table lies within the watermark."""
    rows = runs.opened(spark, d, "volops_dallasdoinggood").where("id is not null").select("id", F.col("ingested_at").cast("timestamp").alias("at"))
    return runs.drained(runs.first_sightings(rows, "id", "at", "3650 days"), "sightings").select("id")


@query(ADMITTED)
def stream_quota(spark: SparkSession, d: str) -> DataFrame:
    return runs.drained(runs.admitted(runs.opened(spark, d, "search_log")), "admitted")


@query(f"SELECT b.ord FROM volops_batches b WHERE b.id IS NULL OR b.id NOT IN (SELECT id FROM {LISTINGS} WHERE id IS NOT NULL)")
def stream_digest(spark: SparkSession, d: str) -> DataFrame:
    """Arriving rows against a static snapshot: those whose id it lacks."""
    known = table(spark, d, "volops_dallasdoinggood").where("id is not null").select("id").distinct().withColumn("seen", F.lit(True))
    arriving = runs.opened(spark, d, "volops_batches").select("ord", "id")
    return runs.drained(arriving.join(known, "id", "left").where("seen is null").select("ord"), "digest")


@query("SELECT event_type, n FROM (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2) WHERE day < (SELECT date_trunc('day', max(ts)) FROM events)")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by day and type of the days that the watermark has passed: all but the last."""
    rows = runs.opened(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    return runs.drained(runs.windowed(rows, "at", ["event_type"], "1 day", "0 seconds"), "daily").select("event_type", "n")


@query(f"""SELECT ord, CASE WHEN regexp_matches(coalesce(schedule.raw, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'one_time' WHEN regexp_matches(coalesce(schedule.raw, ''), '(?i)every|weekly|days\\b') THEN 'ongoing' ELSE 'unclear' END AS kind FROM {LISTINGS} WHERE expiry IS NULL""")
def stream_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an expiry stamp, asked of a model as they arrive."""
    rows = runs.opened(spark, d, "volops_dallasdoinggood").where("expiry is null").select("ord", F.col("schedule.raw").alias("raw"))
    return runs.stamped(rows, "ord", models.when, "kind string, ends_on string", "stamps").select("ord", "kind")
