"""Facets, their filters, and roll-ups by body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.tags import TAXONOMY, known_tags, tag_label, tidy_tags
from tallyfold.functions.text import blank_as_null, squeezed, stripped
from tallyfold.operators import expiry, facets
from tallyfold.queries.places import TOWN
from tallyfold.queries.registry import LISTINGS, query
from tallyfold.queries.registry import TAXONOMY as TAX
from tallyfold.queries.registry import squeezed as sq
from tallyfold.storage import table

SOURCES = ("curated", "dallasdoinggood", "volunteergarland", "volunteermckinney", "idealist", "voly_dallas")
_IN = ", ".join(f"'{s}'" for s in SOURCES)
_LIVE = f"(SELECT * FROM {LISTINGS} WHERE status IS DISTINCT FROM 'inactive')"
_OK_TAG = r"trim(t) <> '' AND length(trim(t)) <= 40 AND lower(trim(t)) NOT IN ('instagram','facebook','twitter','linkedin','tiktok','youtube','snapchat','pinterest','threads') AND NOT regexp_matches(trim(t), '(?i)\b(posted by|agency|see more|sign up|click here|share opportunity|respond|calendar|icon)\b') AND NOT regexp_matches(trim(t), '[a-z][A-Z]')"
_TIDY = f"list_filter(list_transform(coalesce(cause_tags, []), lambda t: CASE WHEN {_OK_TAG} THEN trim(t) END), lambda t: t IS NOT NULL)"
_FIRSTS = f"list_filter({_TIDY}, lambda t, i: list_position(list_transform({_TIDY}, lambda u: lower(u)), lower(t)) = i)"
_TAGS = f"CASE WHEN len(coalesce(unified_tags, [])) > 0 THEN unified_tags ELSE {_FIRSTS} END"


def _live(spark: SparkSession, d: str) -> DataFrame:
    return facets.live(table(spark, d, "volops_dallasdoinggood"))


@query(f"SELECT {sq('source')} AS source, count(*) AS n FROM {_LIVE} WHERE {sq('source')} IN ({_IN}) GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM {_LIVE}")
def facet_source(spark: SparkSession, d: str) -> DataFrame:
    return facets.by_source(_live(spark, d), SOURCES)


@query(f"SELECT cause, count(*) AS n FROM (SELECT unnest({_TAGS}) AS cause FROM {_LIVE}) WHERE cause IN (SELECT unnest({TAX})) GROUP BY cause")
def facet_cause(spark: SparkSession, d: str) -> DataFrame:
    return facets.by_cause(_live(spark, d))


@query(f"SELECT city, count(*) AS n FROM (SELECT {TOWN} AS city FROM {_LIVE}) WHERE city IS NOT NULL GROUP BY city HAVING count(*) >= 3 ORDER BY n DESC, city LIMIT 18")
def facet_city(spark: SparkSession, d: str) -> DataFrame:
    return facets.by_town(_live(spark, d))


@query(f"SELECT city, count(*) AS n FROM (SELECT {TOWN} AS city FROM {_LIVE}) WHERE city IS NOT NULL GROUP BY city HAVING count(*) >= 8")
def city_pages(spark: SparkSession, d: str) -> DataFrame:
    return facets.by_town(_live(spark, d), 8, None)


@query(f"""SELECT count(*) AS all_rows, count(*) FILTER (expiry.kind = 'one_time' AND coalesce(expiry.ends_on, '') <> '') AS events, count(*) FILTER (expiry.kind = 'ongoing') AS ongoing FROM {_LIVE}""")
def facet_timing(spark: SparkSession, d: str) -> DataFrame:
    return facets.timing(_live(spark, d))


@query(f"""SELECT ord FROM (SELECT ord, {sq('source')} AS src, {_TAGS} AS tags, {TOWN} AS city, expiry FROM {_LIVE}) WHERE src IN ('dallasdoinggood', 'curated') AND list_has_any(tags, ['arts', 'health', 'legal']) AND expiry.kind = 'ongoing'""")
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).where(facets.chosen(("dallasdoinggood", "curated"), ("arts", "health", "legal"), (), "ongoing")).select("ord")


@query(f"SELECT ord, array_to_string({_FIRSTS}, '|') AS tidy, array_to_string(list_filter({TAX}, lambda t: list_contains(coalesce(unified_tags, []), t)), '|') AS known FROM {LISTINGS}")
def tag_cleaning(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "volops_dallasdoinggood")
    known = F.filter(F.array(*map(F.lit, TAXONOMY)), lambda t: F.array_contains(known_tags(F.col("unified_tags")), t))
    return rows.select("ord", F.array_join(tidy_tags(F.col("cause_tags")), "|").alias("tidy"), F.array_join(known, "|").alias("known"))


@query(f"SELECT t AS tag, upper(replace(t, '_', ' ')[1]) || replace(t, '_', ' ')[2:] AS label FROM (SELECT unnest({TAX}) AS t)")
def tag_labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TAXONOMY], "tag string").select("tag", tag_label(F.col("tag")).alias("label"))


_NAME = "nullif(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(org_name), '(?i)\\s*(Posted By|Agency|Brought To You By|Get Connected)\\s*$', '')), '(?i)\\s*(Posted By|Agency|Brought To You By|Get Connected)\\s*$', '')), '(?i)\\s*(Posted By|Agency|Brought To You By|Get Connected)\\s*$', '')), '')"
_R = f"SELECT ord, {_NAME} AS name, lower({_NAME}) AS key, {_TAGS} AS tags, {TOWN} AS city, {sq('source')} AS source, nullif(org_url, '') AS url FROM {_LIVE}"


@query(f"""WITH r AS (SELECT * FROM ({_R}) WHERE key IS NOT NULL), m AS (SELECT key, arg_min(name, ord) AS name, count(*) AS n, arg_min(url, ord) FILTER (url IS NOT NULL) AS url FROM r GROUP BY key),
t AS (SELECT key, string_agg(tag, '|' ORDER BY c DESC, tag) AS causes FROM (SELECT key, tag, count(*) AS c FROM (SELECT key, unnest(tags) AS tag FROM r) WHERE tag IN (SELECT unnest({TAX})) GROUP BY key, tag) GROUP BY key),
c AS (SELECT key, string_agg(city, '|' ORDER BY city) AS cities FROM (SELECT DISTINCT key, city FROM r WHERE city <> '') GROUP BY key), s AS (SELECT key, string_agg(source, '|' ORDER BY source) AS sources FROM (SELECT DISTINCT key, source FROM r WHERE source <> '') GROUP BY key)
SELECT m.key, name, n, url, coalesce(causes, '') AS causes, coalesce(cities, '') AS cities, coalesce(sources, '') AS sources FROM m LEFT JOIN t USING (key) LEFT JOIN c USING (key) LEFT JOIN s USING (key)""")
def org_summary(spark: SparkSession, d: str) -> DataFrame:
    return facets.bodies(_live(spark, d))


@query(f"""WITH r AS (SELECT lower(trim(org_name)) AS key, CASE WHEN len(coalesce(unified_tags, [])) > 0 THEN unified_tags ELSE coalesce(cause_tags, []) END AS tags, {TOWN} AS city FROM {_LIVE} WHERE lower(trim(org_name)) <> ''),
c AS (SELECT key, string_agg(t, '|' ORDER BY t) AS causes FROM (SELECT DISTINCT key, unnest(tags) AS t FROM r) GROUP BY key), y AS (SELECT key, string_agg(city, '|' ORDER BY city) AS cities FROM (SELECT DISTINCT key, city FROM r WHERE city IS NOT NULL) GROUP BY key)
SELECT r.key, count(*) AS n, coalesce(any_value(causes), '') AS causes, coalesce(any_value(cities), '') AS cities FROM r LEFT JOIN c USING (key) LEFT JOIN y USING (key) GROUP BY r.key""")
def org_derive(spark: SparkSession, d: str) -> DataFrame:
    return facets.index_bodies(_live(spark, d))


@query(f"SELECT coalesce(nullif(org_name, ''), 'Unknown') AS org, count(*) AS n FROM {LISTINGS} GROUP BY 1")
def org_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "volops_dallasdoinggood").groupBy(F.coalesce(blank_as_null(F.col("org_name")), F.lit("Unknown")).alias("org")).agg(F.count("*").alias("n"))


@query(f"SELECT key, n, rank FROM (SELECT key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key)::int AS rank FROM ({_R}) WHERE key IS NOT NULL GROUP BY key) WHERE rank <= 20")
def org_ranking(spark: SparkSession, d: str) -> DataFrame:
    counts = _live(spark, d).select(facets.body_key(F.col("org_name")).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    return expiry.latest_first(20, F.desc("n"), F.col("key"))(counts)


@query(f"SELECT key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key) AS rank FROM ({_R}) WHERE key IS NOT NULL GROUP BY key")
def org_order(spark: SparkSession, d: str) -> DataFrame:
    """Every body, those with most listings first."""
    counts = _live(spark, d).select(facets.body_key(F.col("org_name")).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    return expiry.in_order(F.desc("n"), F.col("key"))(counts)


@query(f"""WITH k AS (SELECT key FROM ({_R}) WHERE key IS NOT NULL GROUP BY key ORDER BY count(*) DESC, key LIMIT 1) SELECT ord, key FROM ({_R}) WHERE key = (SELECT key FROM k)""")
def listings_for_org(spark: SparkSession, d: str) -> DataFrame:
    rows = _live(spark, d).select("ord", facets.body_key(F.col("org_name")).alias("key")).where("key is not null")
    top = rows.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(1).select("key")
    return rows.join(F.broadcast(top), "key").select("ord", "key")  # one row


@query(f"""WITH b AS (SELECT key, any_value(cities) AS cities FROM (SELECT r.key, string_agg(DISTINCT city, '|') AS cities FROM ({_R}) r WHERE key IS NOT NULL GROUP BY key) GROUP BY key),
e AS (SELECT DISTINCT key, city FROM ({_R}) WHERE key IS NOT NULL AND city IS NOT NULL) SELECT city, count(*) AS n FROM e GROUP BY city ORDER BY n DESC, city LIMIT 20""")
def org_facet_city(spark: SparkSession, d: str) -> DataFrame:
    from tallyfold.operators.places import town

    pairs = _live(spark, d).select(facets.body_key(F.col("org_name")).alias("key"), town().alias("city")).where("key is not null and city is not null").distinct()
    return pairs.groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(20)


@query(f"""SELECT count(*) FILTER (w) AS opportunities, count(DISTINCT CASE WHEN w THEN key END) AS organizations, count(*) FILTER (w AND ev) AS events
FROM (SELECT contains(lower(concat_ws(' ', opportunity_title, org_name, description_short)), 'garden') AS w, lower({_NAME}) AS key, coalesce(expiry.kind = 'one_time' AND coalesce(expiry.ends_on, '') <> '', false) AS ev FROM {_LIVE})""")
def multi_tab_counts(spark: SparkSession, d: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "opportunity_title", "org_name", "description_short"))
    rows = _live(spark, d).select(hay.contains("garden").alias("w"), facets.body_key(F.col("org_name")).alias("key"), F.coalesce(expiry.is_event(), F.lit(False)).alias("ev"))
    return rows.agg(F.count_if("w").alias("opportunities"), F.countDistinct(F.when(F.col("w"), F.col("key"))).alias("organizations"), F.count_if(F.col("w") & F.col("ev")).alias("events"))


@query("SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1")
def facet_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))


@query(f"SELECT max(last_scraped) AS newest, max(ingested_at) AS ingested FROM {LISTINGS}")
def last_updated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "volops_dallasdoinggood").agg(F.max("last_scraped").alias("newest"), F.max("ingested_at").alias("ingested"))


@query(f"SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'inactive') AS inactive, count(*) FILTER (schedule.recurring) AS recurring FROM {LISTINGS}")
def qc_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "volops_dallasdoinggood")
    return rows.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "inactive").alias("inactive"), F.count_if(F.col("schedule.recurring")).alias("recurring"))


@query(f"""SELECT o.id, count(v.ord) AS listings, count(v.ord) FILTER (v.status = 'inactive') AS excluded FROM orgs o LEFT JOIN {LISTINGS} v ON v.org_id = o.id GROUP BY o.id""")
def yield_per_org(spark: SparkSession, d: str) -> DataFrame:
    # counted per body first: the hot body is one row when it meets the list
    counts = table(spark, d, "volops_dallasdoinggood").where("org_id is not null").groupBy(F.col("org_id").alias("id")).agg(F.count("*").alias("listings"), F.count_if(F.col("status") == "inactive").alias("excluded"))
    return table(spark, d, "orgs").select("id").join(counts, "id", "left").fillna(0)


@query("SELECT type, count(*) AS n FROM opportunities GROUP BY type")
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "opportunities").groupBy("type").agg(F.count("*").alias("n"))


@query(f"SELECT v.ord, s.label FROM {LISTINGS} v LEFT JOIN source_ranks s ON {sq('v.source')} = s.source")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "volops_dallasdoinggood").select("ord", squeezed(F.col("source")).alias("source"))
    return rows.join(table(spark, d, "source_ranks").select("source", "label"), "source", "left").select("ord", "label")


@query(f"SELECT DISTINCT lower(trim(name)) AS name FROM (SELECT org_name AS name FROM {LISTINGS} UNION ALL SELECT name FROM orgs) WHERE trim(name) <> ''")
def name_union(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "volops_dallasdoinggood").select(F.col("org_name").alias("name")).unionByName(table(spark, d, "orgs").select("name"))
    return names.select(F.lower(stripped(F.col("name"))).alias("name")).where("name <> ''").distinct()



@query(f"""SELECT org, n FROM (SELECT coalesce(nullif(org_name, ''), 'Unknown') AS org, count(*) AS n, bool_or(contains(lower(opportunity_title), 'garden')) AS titled, bool_or(list_has_any(coalesce(unified_tags, []), ['arts', 'health'])) AS tagged FROM {LISTINGS} GROUP BY 1) WHERE (titled OR contains(lower(org), 'garden')) AND tagged""")
def org_search(spark: SparkSession, d: str) -> DataFrame:
    """Bodies found by their name or any of their titles, of which any listing carries a chosen cause."""
    org = F.coalesce(blank_as_null(F.col("org_name")), F.lit("Unknown"))
    tagged = F.arrays_overlap(F.coalesce("unified_tags", F.array().cast("array<string>")), F.array(F.lit("arts"), F.lit("health")))
    found = table(spark, d, "volops_dallasdoinggood").groupBy(org.alias("org")).agg(F.count("*").alias("n"), F.bool_or(F.lower("opportunity_title").contains("garden")).alias("titled"), F.bool_or(tagged).alias("tagged"))
    return found.where((F.coalesce("titled", F.lit(False)) | F.lower("org").contains("garden")) & F.col("tagged")).select("org", "n")


@query(f"""SELECT rank, '{{"@type":"ListItem","position":' || rank || ',"name":' || to_json(name) || '}}' AS item FROM (SELECT opportunity_title AS name, row_number() OVER (ORDER BY coalesce(last_scraped, '') DESC, ord)::int AS rank FROM {_LIVE}) WHERE rank <= 50""")
def item_list(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty live listings as linked-data items."""
    rows = _live(spark, d).select("ord", F.coalesce("last_scraped", F.lit("")).alias("seen"), F.col("opportunity_title").alias("name"))
    top = expiry.latest_first(50, F.col("seen").desc(), F.col("ord"))(rows)
    return top.select("rank", F.to_json(F.struct(F.lit("ListItem").alias("@type"), F.col("rank").alias("position"), "name")).alias("item"))


@query("SELECT name, row_number() OVER (ORDER BY name, id)::int AS rank FROM orgs ORDER BY name, id LIMIT 100")
def snapshot_order(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot's output order, binary, the first hundred."""
    return expiry.latest_first(100, F.col("name"), F.col("id"))(table(spark, d, "orgs").select("name", "id")).select("name", "rank")
