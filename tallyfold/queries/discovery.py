"""Coverage, blocklists and triage of candidate bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.text import body_name
from tallyfold.functions.web import host
from tallyfold.operators import triage
from tallyfold.queries.registry import LISTINGS, query
from tallyfold.queries.texts import BODY, HOST
from tallyfold.storage import table

_HOST = HOST.format(x="org_url")
_NAMES = f"SELECT DISTINCT {BODY.format(x='name')} AS name FROM orgs WHERE {BODY.format(x='name')} <> ''"
_DOMAINS = f"SELECT DISTINCT {HOST.format(x='volunteer_url')} AS domain FROM orgs WHERE {HOST.format(x='volunteer_url')} <> ''"
_LEDGER = f"SELECT DISTINCT {_HOST} AS domain FROM {LISTINGS} WHERE status = 'inactive' AND {_HOST} <> ''"
_CAND = f"SELECT ord AS id, {BODY.format(x='org_name')} AS name, {_HOST} AS domain FROM volops_batches"
_TRIAGE = f"""WITH c AS ({_CAND}), k AS ({_NAMES}), n AS (SELECT DISTINCT c.name FROM c JOIN k ON contains(c.name, k.name) OR contains(k.name, c.name) WHERE c.name <> ''),
t AS (SELECT id, domain, CASE WHEN domain = '' THEN 'no_domain' WHEN domain = 'example' OR domain = 'signup-hub.example' OR suffix(domain, '.signup-hub.example') THEN 'blocklisted' WHEN domain IN ({_LEDGER}) THEN 'ledgered'
 WHEN domain IN ({_DOMAINS}) OR name IN (SELECT name FROM n) THEN 'covered' ELSE 'keep' END AS reason FROM c)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "volops_batches").select(F.col("ord").alias("id"), F.col("org_name").alias("name"), F.col("org_url").alias("url"))


def _blocklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("signup-hub.example",), ("example",)], "domain string").where("domain <> 'example'")


def _triaged(spark: SparkSession, d: str) -> DataFrame:
    orgs, rows = table(spark, d, "orgs"), table(spark, d, "volops_dallasdoinggood")
    ledger = rows.where("status = 'inactive'").select(host(F.col("org_url")).alias("domain")).where("domain <> ''")
    domains = orgs.select(host(F.col("volunteer_url")).alias("domain")).where("domain <> ''")
    return triage.triaged(_candidates(spark, d), _blocklist(spark), ledger, domains, orgs.select(body_name(F.col("name")).alias("name")))


@query(f"SELECT DISTINCT {_HOST} AS domain FROM {LISTINGS} WHERE {_HOST} = 'signup-hub.example' OR suffix({_HOST}, '.signup-hub.example')")
def blocklist_subdomain(spark: SparkSession, d: str) -> DataFrame:
    return triage.blocked(table(spark, d, "volops_dallasdoinggood").select(host(F.col("org_url")).alias("domain")), "domain", _blocklist(spark))


@query(f"""WITH a AS (SELECT DISTINCT {BODY.format(x='org_name')} AS name FROM {LISTINGS}), k AS ({_NAMES}) SELECT DISTINCT a.name FROM a JOIN k ON contains(a.name, k.name) OR contains(k.name, a.name) WHERE a.name <> ''""")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "volops_dallasdoinggood").select(body_name(F.col("org_name")).alias("name"))
    return triage.known_names(asked, table(spark, d, "orgs").select(body_name(F.col("name")).alias("name")))


@query(f"SELECT DISTINCT name FROM (SELECT {BODY.format(x='org_name')} AS name FROM {LISTINGS} UNION ALL SELECT {BODY.format(x='name')} FROM orgs) WHERE name <> ''")
def coverage_set(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "volops_dallasdoinggood").select(body_name(F.col("org_name")).alias("name")).unionByName(table(spark, d, "orgs").select(body_name(F.col("name")).alias("name")))
    return names.where("name <> ''").distinct()


@query(f"SELECT v.ord, o.k IS NOT NULL AS known FROM {LISTINGS} v LEFT JOIN (SELECT DISTINCT lower(name) AS k FROM orgs) o ON lower(v.org_name) = o.k")
def already_known(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orgs").select(F.lower("name").alias("k")).distinct().withColumn("there", F.lit(True))
    rows = table(spark, d, "volops_dallasdoinggood").select("ord", F.lower("org_name").alias("k"))
    return rows.join(known, "k", "left").select("ord", F.coalesce("there", F.lit(False)).alias("known"))


@query(_TRIAGE + " SELECT id, domain, reason FROM t")
def triage_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _triaged(spark, d)


@query(_TRIAGE + """, f AS (SELECT DISTINCT reason, domain FROM t WHERE domain <> '' QUALIFY dense_rank() OVER (PARTITION BY reason ORDER BY domain) <= 8), s AS (SELECT reason, string_agg(domain, '|' ORDER BY domain) AS samples FROM f GROUP BY reason)
SELECT t.reason, count(*) AS n, coalesce(any_value(s.samples), '') AS samples FROM t LEFT JOIN s ON t.reason = s.reason GROUP BY t.reason""")
def triage_funnel(spark: SparkSession, d: str) -> DataFrame:
    return triage.funnel(_triaged(spark, d))


@query("SELECT vec_id AS id, round((label % 10) / 10.0, 1) AS confidence FROM embeddings WHERE label % 2 = 0 AND (label % 10) / 10.0 >= 0.6 ORDER BY confidence DESC, id LIMIT 10")
def select_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, F.lit("accept")).otherwise(F.lit("reject")).alias("decision"), F.round((F.col("label") % 10) / 10.0, 1).cast("double").alias("confidence"))
    return triage.accepted(v).select("id", "confidence")


@query("""WITH n AS (SELECT count(*) AS n FROM gazetteer), g AS (SELECT city, (((row_number() OVER (ORDER BY gaz_id) - 1 - (7 * 5) % n.n) % n.n + n.n) % n.n) AS turn FROM gazetteer, n), t AS (SELECT city, turn FROM g ORDER BY turn LIMIT 12), c AS (SELECT unnest(['legal aid', 'food pantry', 'animal shelter']) AS cause)
SELECT cause || ' ' || city || ', Texas' AS q, turn::bigint AS turn FROM t, c""")
def query_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every cause for each of twelve towns: the causes are an array of the row, no join."""
    towns = triage.rotated(table(spark, d, "gazetteer"), "gaz_id", 7, 5, 12)
    return towns.select(F.explode(F.array(F.lit("legal aid"), F.lit("food pantry"), F.lit("animal shelter"))).alias("cause"), "city", "turn").select(F.concat_ws("", "cause", F.lit(" "), "city", F.lit(", Texas")).alias("q"), F.col("turn").cast("long").alias("turn"))


@query("SELECT id, list_contains(list_concat([volunteer_url], coalesce(fallback_urls, [])), 'https://www.' || replace(split_part(volunteer_url, '.', 2), 'x', 'x') || '.example/join') AS echoed FROM orgs WHERE volunteer_url IS NOT NULL")
def evidence_echo(spark: SparkSession, d: str) -> DataFrame:
    claimed = F.concat(F.lit("https://www."), F.split_part("volunteer_url", F.lit("."), F.lit(2)), F.lit(".example/join"))
    seen = F.concat(F.array("volunteer_url"), F.coalesce("fallback_urls", F.array().cast("array<string>")))
    return table(spark, d, "orgs").where("volunteer_url is not null").select("id", F.array_contains(seen, claimed).alias("echoed"))


