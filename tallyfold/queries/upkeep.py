"""Keeping collections: scrapes of one source, upserts, review rows, seeds, pages of events, query language, rows of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.web import host
from tallyfold.operators import expiry, merge, search
from tallyfold.queries import retrieval
from tallyfold.queries.registry import LISTINGS, ORACLE, query
from tallyfold.sources import files
from tallyfold.storage import new_folder, table

_LAST = "SELECT * FROM {t} WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1"


@query(f"""WITH o AS ({_LAST.format(t=LISTINGS)}), n AS ({_LAST.format(t="(SELECT * FROM volops_batches WHERE source = 'voly_dallas')")})
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.source ELSE o.source END AS source, CASE WHEN n.id IS NOT NULL THEN 'active' WHEN o.source = 'voly_dallas' THEN 'inactive' ELSE o.status END AS status
FROM o FULL OUTER JOIN n ON o.id = n.id""")
def snapshot_merge_by_source(spark: SparkSession, d: str) -> DataFrame:
    """A fresh scrape of one source: only this source's rows can become inactive."""
    return merge.merge_scraped(table(spark, d, LISTINGS), table(spark, d, "volops_batches"), "voly_dallas")


@query(f"""WITH n AS ({_LAST.format(t='volops_batches')}) SELECT ord, id, opportunity_title FROM n
UNION ALL SELECT ord, id, opportunity_title FROM {LISTINGS} WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM n)""")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    """New rows over old ones of the same id, written in whole with retries and read back."""
    columns = ["ord", "id", "opportunity_title"]
    path = new_folder(spark, "upsert")
    files.replace_table(table(spark, d, LISTINGS).select(*columns), path)
    both = merge.upserted(spark.read.parquet(path), table(spark, d, "volops_batches").select(*columns), "id", "ord")
    files.retried(lambda: files.replace_table(both, path))
    return spark.read.parquet(path)


@query(f"SELECT ord, org_name, opportunity_title FROM {LISTINGS} WHERE status IS DISTINCT FROM 'inactive' AND org_id IN (SELECT id FROM orgs WHERE active)")
def curated_rows(spark: SparkSession, d: str) -> DataFrame:
    bodies = table(spark, d, "orgs").where("active")
    return merge.of_bodies(table(spark, d, LISTINGS), bodies).select("ord", "org_name", "opportunity_title")


_KIND = "CASE expiry.kind WHEN 'one_time' THEN 'event' WHEN 'ongoing' THEN 'ongoing' END"
_ENDS = "CASE expiry.kind WHEN 'one_time' THEN ' · ' ELSE ' · thru ' END || nullif(expiry.ends_on, '')"


@query(f"""SELECT ord, true AS include, coalesce(id, '') AS id, coalesce(org_name, '') AS org, coalesce(opportunity_title, '') AS title, coalesce(address.city, '') AS city,
coalesce({_KIND} || coalesce({_ENDS}, ''), nullif(expiry.kind, ''), '—') AS "when", coalesce(nullif(description_short, ''), description_long, '') AS description FROM {LISTINGS}""")
def review_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a reviewer sees of a row, with a label of when it takes place."""
    named, ends = F.when(F.col("expiry.kind") == "one_time", "event").when(F.col("expiry.kind") == "ongoing", "ongoing"), F.nullif(F.col("expiry.ends_on"), F.lit(""))
    until = F.coalesce(F.concat(F.when(F.col("expiry.kind") == "one_time", " · ").otherwise(" · thru "), ends), F.lit(""))
    when = F.coalesce(F.concat(named, until), F.nullif(F.col("expiry.kind"), F.lit("")), F.lit("—"))
    shown = {"id": F.col("id"), "org": F.col("org_name"), "title": F.col("opportunity_title"), "city": F.col("address.city"), "description": F.coalesce(F.nullif(F.col("description_short"), F.lit("")), F.col("description_long"))}
    return table(spark, d, LISTINGS).select("ord", F.lit(True).alias("include"), when.alias("when"), *[F.coalesce(c, F.lit("")).alias(n) for n, c in shown.items()])


@query(f"""SELECT ord FROM {LISTINGS} WHERE list_contains(coalesce(cause_tags, []), 'Animals') AND (contains(lower(coalesce(opportunity_title, '')), 'animal') OR contains(lower(coalesce(org_name, '')), 'animal') OR contains(lower(coalesce(description_short, '')), 'animal'))""")
def single_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    """One tag and one piece of text anywhere in title, body or short text."""
    rows = table(spark, d, LISTINGS).where(F.array_contains(F.coalesce("cause_tags", F.array().cast("array<string>")), "Animals"))
    return rows.where(" OR ".join(f"contains(lower(coalesce({c}, '')), 'animal')" for c in ("opportunity_title", "org_name", "description_short"))).select("ord")


@query("""SELECT id, event_date, (row_number() OVER (ORDER BY event_date, id) - 1) // 50 + 1 AS page FROM opportunities WHERE type = 'listing' AND list_contains(causes, 'community') AND event_date >= '2026-02-01'""")
def events_scan(spark: SparkSession, d: str) -> DataFrame:
    """Events of a category from a day on, in pages of fifty; the last page is followed by none."""
    rows = table(spark, d, "opportunities").where("type = 'listing' and array_contains(causes, 'community') and event_date >= date'2026-02-01'")
    ranked = expiry.in_order(F.col("event_date"), F.col("id"))(rows)
    return ranked.select("id", "event_date", (F.floor((F.col("rank") - 1) / 50) + 1).alias("page"))


@query(r"""SELECT '' AS name, regexp_replace(lower(regexp_extract(volunteer_url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]*)', 1)), '^www\.', '') AS domain,
CASE WHEN contains(volunteer_url, '://') THEN volunteer_url ELSE 'https://' || volunteer_url END AS url, '' AS snippet FROM orgs WHERE volunteer_url IS NOT NULL""")
def seeded_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Addresses picked by hand in place of what a search would find."""
    given = table(spark, d, "orgs").where("volunteer_url is not null").select(F.col("volunteer_url").alias("u"))
    url = F.when(F.col("u").contains("://"), F.col("u")).otherwise(F.concat(F.lit("https://"), F.col("u")))
    return given.select(F.lit("").alias("name"), host(F.col("u")).alias("domain"), url.alias("url"), F.lit("").alias("snippet"))


@query("SELECT event_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')::date AS day FROM events")
def city_day(spark: SparkSession, d: str) -> DataFrame:
    """The day by the clocks of a place that changes them."""
    return table(spark, d, "events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("America/Chicago"), F.col("ts").cast("timestamp_ntz")).cast("date").alias("day"))


_LEX = f"SELECT row_no, lex, ' ' || array_to_string(lex, ' ') || ' ' AS line FROM (SELECT row_no, {retrieval._S2} AS lex FROM opportunities)"


@query(f"SELECT row_no FROM ({_LEX}) WHERE (contains(line, ' food pantry ') AND list_contains(lex, 'sort') AND NOT list_contains(lex, 'virtual')) OR (list_contains(lex, 'animal') AND NOT contains(line, ' rescue league '))")
def websearch(spark: SparkSession, d: str) -> DataFrame:
    """Phrases, alternatives and exclusions."""
    return table(spark, d, "opportunities").where(search.websearch(F.col("content"), 'the "food pantry" sorting -virtual OR animals -"rescue league"')).select("row_no")


@query(f"SELECT h.id, h.score, o.type, o.city, o.content FROM ({ORACLE['hybrid_rrf']}) h JOIN opportunities o USING (id)")
def hybrid_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows themselves that hybrid retrieval finds."""
    hits = retrieval.hybrid_rrf(spark, d).select("id", "score")
    return table(spark, d, "opportunities").join(F.broadcast(hits), "id").select("id", "score", "type", "city", "content")  # at most as many as were asked for
