"""Keyword, vector and hybrid search, and the quota that guards it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.operators import expiry, quota, search
from tallyfold.queries.registry import LISTINGS, query
from tallyfold.storage import table

#: What makes a post worth showing: words of helping, and of place. Fixed values.
HELP_WORDS = (
    "volunteer", "volunteering", "volunteers needed", "looking for volunteers", "food bank", "food pantry", "habitat for humanity", "animal shelter", "soup kitchen", "fundraiser", "charity", "nonprofit", "non-profit", "community garden",
    "clean up", "cleanup", "tutoring", "mentor", "help needed", "help us", "join us", "sign up", "sign-up", "free", "donate", "donation", "giveback", "give back",
)
PLACE_WORDS = ("richardson", "garland", "plano", "allen", "mckinney", "collin county", "dallas county", "dfw", "north dallas", "tx", "texas")
_HAY = "lower(concat_ws(' ', opportunity_title, org_name, description_short, description_long, array_to_string(unified_tags, ' '), address.city, source))"
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_STOP = _LIST(sorted(search.STOP_WORDS))
_COS = "list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)))"
_Q = "SELECT embedding::DOUBLE[] AS q FROM opportunities WHERE row_no = (SELECT min(row_no) FROM opportunities WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)"
_USABLE = "embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0"
_S1 = "CASE WHEN length(w) > 4 AND suffix(w, 'ies') THEN w[:-4] || 'y' WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN w[:-2] ELSE w END"
_S2 = f"list_transform(list_transform(list_transform(list_filter(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w)), lambda w: {_S1}), lambda w: CASE WHEN length(w) > 5 AND suffix(w, 'ing') THEN w[:-4] ELSE w END), lambda w: CASE WHEN length(w) > 4 AND suffix(w, 'ed') THEN w[:-3] ELSE w END)"
TEXT = "sorting donated books"
_STEMS = sorted({search.stem_word(w) for w in TEXT.split()})


def _lexical(stems: list[str]) -> str:
    counts = [f"len(list_filter(lex, lambda x: x = '{s}'))" for s in stems]
    return f"CASE WHEN {' AND '.join(c + ' > 0' for c in counts)} THEN ({' + '.join(counts)}) / (1 + ln(1.0 + len(lex))) END"


def _hybrid_sql(where: str) -> str:
    return f"""WITH b AS (SELECT id, embedding, q, {_S2} AS lex FROM opportunities, ({_Q}) WHERE {where}),
v AS (SELECT id, row_number() OVER (ORDER BY {_COS} DESC, id) AS r FROM b WHERE {_USABLE} QUALIFY r <= 120),
f AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT id, {_lexical(_STEMS)} AS s FROM b) WHERE s IS NOT NULL QUALIFY r <= 120)
SELECT coalesce(v.id, f.id) AS id, round(coalesce(1.0::double / (60 + v.r), 0) + coalesce(1.0::double / (60 + f.r), 0), 12) AS score FROM v FULL OUTER JOIN f ON v.id = f.id ORDER BY score DESC, id LIMIT 16"""


def _vector(spark: SparkSession, d: str) -> list[float]:
    """The vector that the example searches use: the first usable one of the corpus."""
    rows = table(spark, d, "opportunities").where("embedding is not null and exists(embedding, x -> x <> 0)")
    return rows.orderBy("row_no").select("embedding").first()["embedding"]


@query(f"SELECT ord FROM {LISTINGS} WHERE contains({_HAY}, 'hygiene kits') AND contains({_HAY}, 'library')")
def keyword_and(spark: SparkSession, d: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "opportunity_title", "org_name", "description_short", "description_long", F.array_join("unified_tags", " "), "address.city", "source"))
    return table(spark, d, "volops_dallasdoinggood").where(search.has_all(hay, search.parsed('"hygiene kits" Library'))).select("ord")


@query("SELECT doc_id FROM documents WHERE kind = 'post' AND contains(lower(concat_ws(' ', text, source)), 'night-shift')")
def post_keyword(spark: SparkSession, d: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "text", "source"))
    return table(spark, d, "documents").where("kind = 'post'").where(search.has_all(hay, search.parsed("night-shift"))).select("doc_id")


@query(f"""SELECT doc_id, help, place, help + place AS total FROM (SELECT doc_id, published_at, len(list_filter({_LIST(HELP_WORDS)}, lambda w: contains(lower(text), w)))::int AS help, len(list_filter({_LIST(PLACE_WORDS)}, lambda w: contains(lower(text), w)))::int AS place FROM documents WHERE kind = 'post' AND text IS NOT NULL)
WHERE help >= 1 AND help + place >= 2 ORDER BY total DESC, published_at DESC NULLS LAST, doc_id LIMIT 100""")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("kind = 'post' and text is not null").select("doc_id", "published_at", search.hits_of(F.col("text"), HELP_WORDS).alias("help"), search.hits_of(F.col("text"), PLACE_WORDS).alias("place"))
    good = rows.where("help >= 1 and help + place >= 2").withColumn("total", F.col("help") + F.col("place"))
    return good.orderBy(F.desc("total"), F.desc_nulls_last("published_at"), "doc_id").limit(100).select("doc_id", "help", "place", "total")


@query(f"""SELECT doc_id, help, place, help + place AS total, row_number() OVER (ORDER BY help + place DESC, published_at DESC NULLS LAST, doc_id) AS rank FROM (SELECT doc_id, published_at, len(list_filter({_LIST(HELP_WORDS)}, lambda w: contains(lower(text), w)))::int AS help, len(list_filter({_LIST(PLACE_WORDS)}, lambda w: contains(lower(text), w)))::int AS place FROM documents WHERE kind = 'post' AND text IS NOT NULL)
WHERE help >= 1 AND help + place >= 2""")
def relevance_order(spark: SparkSession, d: str) -> DataFrame:
    """Every post worth showing, the most relevant first."""
    rows = table(spark, d, "documents").where("kind = 'post' and text is not null").select("doc_id", "published_at", search.hits_of(F.col("text"), HELP_WORDS).alias("help"), search.hits_of(F.col("text"), PLACE_WORDS).alias("place"))
    good = rows.where("help >= 1 and help + place >= 2").withColumn("total", F.col("help") + F.col("place"))
    return expiry.in_order(F.desc("total"), F.desc_nulls_last("published_at"), F.col("doc_id"))(good).select("doc_id", "help", "place", "total", "rank")


@query(f"SELECT id, round({_COS}, 9) AS score FROM opportunities, ({_Q}) WHERE {_USABLE} ORDER BY {_COS} DESC, id LIMIT 8")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(table(spark, d, "opportunities"), _vector(spark, d)).withColumn("score", F.round("score", 9))


@query(f"SELECT id, round({_COS}, 9) AS score FROM opportunities, ({_Q}) WHERE {_USABLE} AND type = 'organization' ORDER BY {_COS} DESC, id LIMIT 8")
def knn_by_type(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(table(spark, d, "opportunities"), _vector(spark, d), of_type="organization").withColumn("score", F.round("score", 9))


@query(_hybrid_sql("type = 'listing'"))
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(table(spark, d, "opportunities"), _vector(spark, d), TEXT).withColumn("score", F.round("score", 12))


_F = search.Filters(causes=("arts", "health", "community"), virtual=False, date_start="2026-01-01", date_end="2026-12-31", today="2026-02-01")


@query(_hybrid_sql("type = 'listing' AND list_has_any(causes, ['arts', 'health', 'community']) AND is_virtual = false AND (event_date IS NULL OR event_date >= '2026-01-01') AND (event_date IS NULL OR event_date <= '2026-12-31') AND (event_date IS NULL OR event_date >= '2026-02-01')"))
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(table(spark, d, "opportunities"), _vector(spark, d), TEXT, _F).withColumn("score", F.round("score", 12))


_LADDER = search.Filters(city="Nowhere Springs", causes=("legal",), date_start="2026-03-01", date_end="2026-03-02")


_STRICT = _hybrid_sql("type = 'listing' AND list_has_any(causes, ['legal'])")


@query(f"WITH a AS ({_STRICT}), z AS ({_hybrid_sql("type = 'listing'")}) SELECT * FROM a WHERE (SELECT count(*) FROM a) >= 3 UNION ALL SELECT * FROM z WHERE (SELECT count(*) FROM a) < 3")
def hybrid_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """No listing lies in a town that does not exist: the rung with causes alone is the first with hits, if it has enough."""
    hits, _ = search.relaxed(table(spark, d, "opportunities"), _vector(spark, d), TEXT, _LADDER)
    return hits.withColumn("score", F.round("score", 12))


@query(f"SELECT row_no, len(lex)::int AS n, array_to_string(lex[1:5], ' ') AS head FROM (SELECT row_no, {_S2} AS lex FROM opportunities)")
def lexemes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "opportunities").select("row_no", search.lexemes(F.col("content")).alias("lex"))
    return rows.select("row_no", F.size("lex").alias("n"), F.array_join(F.slice("lex", 1, 5), " ").alias("head"))


@query(f"""SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY {_COS} DESC, id)::int AS rank FROM opportunities, ({_Q}) WHERE {_USABLE} QUALIFY rank <= 16) WHERE rank IN (5, 2, 9)""")
def answer_picks(spark: SparkSession, d: str) -> DataFrame:
    hits = search.nearest(table(spark, d, "opportunities"), _vector(spark, d), 16)
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return search.picked(ranked, [5, 2, 5, 40, 9]).select("id", "rank")


_AT = "epoch_us(created_at)"
_FIRST = f"SELECT id, ip_hash, created_at FROM search_log WHERE id IS NOT NULL AND created_at IS NOT NULL"


@query(f"SELECT id, count(*) OVER (PARTITION BY ip_hash ORDER BY created_at RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW) AS n_ip, count(*) OVER (ORDER BY created_at RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW) AS n_all FROM ({_FIRST})")
def rolling_24h(spark: SparkSession, d: str) -> DataFrame:
    log = quota.timed(table(spark, d, "search_log")).withColumn("ip_hash", F.coalesce("ip_hash", F.lit("")))
    per_ip = quota.rolling(log, ["ip_hash"], "n_ip").select("id", "n_ip")
    overall = quota.rolling(log, [], "n_all")
    return per_ip.join(overall, "id").select("id", "n_ip", "n_all")


@query("SELECT ip_hash, count(*) AS used, greatest(5 - count(*), 0) AS remaining FROM search_log WHERE created_at > timestamp '2026-03-10 00:00:00' - INTERVAL 1 DAY AND created_at <= timestamp '2026-03-10 00:00:00' GROUP BY ip_hash")
def quota_peek(spark: SparkSession, d: str) -> DataFrame:
    return quota.peek(quota.timed(table(spark, d, "search_log")), 1_773_100_800_000_000)


#: Request after request: the admitted ones of the last day as a list that each decision hands on.
ADMITTED = """WITH RECURSIVE o AS (SELECT id, ip_hash, epoch_us(created_at) AS at_us, row_number() OVER (ORDER BY epoch_us(created_at), id) AS n FROM search_log WHERE id IS NOT NULL AND created_at IS NOT NULL),
r AS (SELECT 0::bigint AS n, 0::bigint AS id, true AS allowed, NULL::varchar AS reason, 0 AS remaining, []::struct(a bigint, i varchar)[] AS kept
UNION ALL SELECT n, id, used < 5 AND len(recent) < 50, CASE WHEN len(recent) >= 50 THEN 'global' WHEN used >= 5 THEN 'ip' END, CASE WHEN used < 5 AND len(recent) < 50 THEN 4 - used ELSE 0 END,
 CASE WHEN used < 5 AND len(recent) < 50 THEN list_append(recent, {'a': at_us, 'i': ip_hash}) ELSE recent END
 FROM (SELECT *, len(list_filter(recent, lambda x: x.i IS NOT DISTINCT FROM ip_hash))::int AS used FROM (SELECT o.*, list_filter(r.kept, lambda x: x.a > o.at_us - 86400000000) AS recent FROM r JOIN o ON o.n = r.n + 1)))
SELECT id, allowed, reason, remaining::int AS remaining FROM r WHERE n > 0"""


@query(ADMITTED)
def quota_admission(spark: SparkSession, d: str) -> DataFrame:
    return quota.admissions(quota.timed(table(spark, d, "search_log")))
