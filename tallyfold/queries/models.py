"""Model plumbing with the deterministic stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.text import first_filled
from tallyfold.operators import expiry, models
from tallyfold.queries.registry import LISTINGS, TAXONOMY, query
from tallyfold.storage import table

_TEXT = "coalesce(nullif(description_long, ''), nullif(description_short, ''))"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "volops_dallasdoinggood").select("ord", F.col("opportunity_title").alias("title"), first_filled(F.col("description_long"), F.col("description_short")).alias("text"), F.col("schedule.raw").alias("raw"))


@query(f"SELECT ord, array_to_string(list_filter({TAXONOMY}, lambda t: contains(lower(coalesce({_TEXT}, '')), replace(t, '_', ' '))), '|') AS tags FROM {LISTINGS}")
def model_tag(spark: SparkSession, d: str) -> DataFrame:
    return models.called(_records(spark, d), "ord", models.tag, "tags string")


@query(f"""SELECT ord, CASE WHEN coalesce(trim(opportunity_title), '') = '' THEN 'pending' WHEN length(coalesce(trim({_TEXT}), '')) < 40 THEN 'reject' ELSE 'keep' END AS decision FROM {LISTINGS}""")
def model_judge(spark: SparkSession, d: str) -> DataFrame:
    """Replies joined back; records without one stay as they were."""
    rows = _records(spark, d)
    replies = models.called(rows, "ord", models.judge, "decision string, category string, reason string").select("ord", "decision")
    return models.stamped(rows.select("ord"), replies, "ord", "decision", "pending")


@query(f"""WITH r AS (SELECT ord, nullif(regexp_extract(coalesce(schedule.raw, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS day, coalesce(schedule.raw, '') AS raw FROM {LISTINGS} WHERE expiry IS NULL)
SELECT ord, CASE WHEN day IS NOT NULL THEN 'one_time' WHEN regexp_matches(raw, '(?i)every|weekly|days\\b') THEN 'ongoing' ELSE 'unknown' END AS kind, day AS ends_on FROM r""")
def model_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Only rows without a stamp are asked; what the model answers is made safe."""
    missing = table(spark, d, "volops_dallasdoinggood").where("expiry is null").select("ord", F.col("schedule.raw").alias("raw"))
    kind, ends = expiry.settled(F.col("kind"), F.col("ends_on"))
    return models.called(missing, "ord", models.when, "kind string, ends_on string").select("ord", kind.alias("kind"), ends.alias("ends_on"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '(?m)^[-*•] (.+)$', 1), '|') AS items FROM documents WHERE kind = 'profile'")
def model_extract(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").where("kind = 'profile'").select("doc_id", "text")
    return models.called(pages, "doc_id", models.extract, "items string")


@query()
def model_embed(spark: SparkSession, d: str) -> DataFrame:
    got = models.called(_records(spark, d).select("ord", "text"), "ord", models.embed, "vector array<double>")
    return got.select("ord", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query("""WITH t AS (SELECT doc_id, (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), 'volunteer', ''))) // 9 AS n FROM documents WHERE kind = 'note')
SELECT doc_id, CASE WHEN n > 1 THEN 'accept' ELSE 'reject' END AS decision, CASE WHEN n = 0 THEN 0.0 ELSE round(least(1.0, 0.5 + 0.1 * n), 2) END::double AS confidence, CASE WHEN n = 0 THEN 'mini' ELSE 'full' END AS stage FROM t""")
def model_two_stage(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").where("kind = 'note'").select("doc_id", "text")
    return models.called(pages, "doc_id", lambda r: models.investigate(r, models.promising, models.decide), "decision string, confidence double, stage string")


@query("SELECT 'Ombrane' AS city, 'legal' AS causes, NULL::boolean AS virtual, '2026-07-01' AS date_start, '2026-07-28' AS date_end")
def model_filters(spark: SparkSession, d: str) -> DataFrame:
    f = models.filters_of("legal help in Ombrane in July", "2026-05-01", ["Ombrane", "Sorvery"])
    return spark.createDataFrame([(f["city"], ",".join(f["causes"]), f["virtual"], f["date_start"], f["date_end"])], "city string, causes string, virtual boolean, date_start string, date_end string")
