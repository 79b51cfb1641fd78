"""Round trips through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import dedup
from tallyfold.queries.registry import LISTINGS, query
from tallyfold.sources import files
from tallyfold.storage import new_folder, table


@query("SELECT id, name, coalesce(active, true) AS active FROM orgs")
def json_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines, read with a declared schema beside a path that does not exist."""
    path = new_folder(spark, "json")
    table(spark, d, "orgs").write.json(path)
    return files.json_lines(spark, [path, f"{path}-missing"], "id string, name string, active boolean").select("id", "name", F.coalesce("active", F.lit(True)).alias("active"))


@query(f"SELECT 'listings' AS origin, ord AS key, opportunity_title AS title, NULL::varchar AS city FROM {LISTINGS} UNION ALL SELECT 'orgs', NULL, name, city FROM orgs")
def multi_source_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "volops_dallasdoinggood").select(F.lit("listings").alias("origin"), F.col("ord").alias("key"), F.col("opportunity_title").alias("title"))
    b = table(spark, d, "orgs").select(F.lit("orgs").alias("origin"), F.col("name").alias("title"), "city")
    return files.union([a, b]).select("origin", "key", "title", "city")


@query("SELECT doc_id::varchar AS id, source AS author, 'https://posts.example/' || doc_id AS link FROM documents WHERE kind = 'post' AND text IS NOT NULL AND source IS NOT NULL")
def atom_feed(spark: SparkSession, d: str) -> DataFrame:
    """Posts written as feed entries, read back as XML."""
    rows = table(spark, d, "documents").where("kind = 'post' and text is not null and source is not null")
    url = F.concat(F.lit("https://posts.example/"), F.col("doc_id"))
    entry = rows.select(F.concat(F.lit("t3_"), F.col("doc_id")).alias("id"), F.lit("post").alias("title"), F.struct(F.concat(F.lit("/u/"), F.col("source")).alias("name")).alias("author"), F.struct(url.alias("_href")).alias("link"), F.regexp_replace("text", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " ").alias("content"))
    path = new_folder(spark, "feed")
    entry.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return files.feed(spark, path).select("id", "author", "link")


@query("SELECT raw > 0 AS ok, raw AS raw_results, gave AS gave_up FROM (SELECT coalesce(sum(value), 0)::bigint AS raw, count(*) FILTER (value = 0)::bigint AS gave FROM (SELECT (event_id % 7)::bigint AS value FROM events))")
def log_health(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "log")
    n = (F.col("event_id") % 7).cast("int")
    table(spark, d, "events").select(F.when(n == 0, F.lit("Giving up on it")).otherwise(F.concat(F.lit("query -> "), n, F.lit(" raw results"))).alias("value")).write.text(path)
    return files.run_log(spark, path)


@query(f"SELECT status, count(*) AS n FROM {LISTINGS} GROUP BY status")
def replace_sink(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over one table: the second replaces the first."""
    path = new_folder(spark, "sink")
    rows = table(spark, d, "volops_dallasdoinggood").select("ord", "status")
    files.replace_table(rows.where("ord % 2 = 0"), path)
    files.replace_table(rows, path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT id, 'listing' AS kind FROM {LISTINGS} WHERE id IS NOT NULL AND status = 'active'")
def sitemap_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "volops_dallasdoinggood").where("status = 'active'").select("id", "ord")
    return dedup.first_seen(rows, "id", "ord").select("id", F.lit("listing").alias("kind"))
