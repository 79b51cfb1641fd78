"""Places: gazetteer resolution, towns, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.geo import clean_town, miles
from tallyfold.operators import expiry, places
from tallyfold.queries.registry import LISTINGS, query
from tallyfold.storage import table

_KEY = "trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
_TITLE = "array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_S = "trim(regexp_replace(trim({x}), '(?i),?\\s*(TX|Texas)$', ''))"
_CLEAN = (
    "CASE WHEN NOT (regexp_matches(trim({x}), '(?i)^(confidential|virtual|n/?a|none|tbd|various|multiple|online|remote|—|-)$') OR length(" + _S + ") > 25 OR len(regexp_split_to_array(" + _S + ", '\\s+')) > 3 "
    "OR regexp_matches(" + _S + ", '(?i)\\b(needed|hours?|click|brought|location|center|rd|street|st|ave|blvd|opportunity|details|view)\\b') OR regexp_matches(" + _S + ", '\\d{{3,}}')) THEN nullif(" + _S + ", '') END"
)
CLEAN_CITY = _CLEAN.format(x="address.city")
TOWN = f"coalesce(nullif(geo.city, ''), {_TITLE.format(x=CLEAN_CITY)})"


def _listings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "volops_dallasdoinggood")


@query(f"""WITH g AS (SELECT {_KEY.format(x='city')} AS name, city, lat, lng, gaz_id FROM gazetteer),
r AS (SELECT v.ord, coalesce(v.is_virtual, false) AS virtual, [{_KEY.format(x='v.address.city')}, {_KEY.format(x='o.city')}, {_KEY.format(x='v.address."full"')}, {_KEY.format(x='v.org_name')}] AS keys FROM {LISTINGS} v LEFT JOIN orgs o ON v.org_id = o.id),
t AS (SELECT ord, unnest([0, 1, 2, 3]) AS nth, unnest(keys) AS key FROM r WHERE NOT virtual),
h AS (SELECT t.ord, arg_min({{'city': g.city, 'lat': g.lat, 'lng': g.lng, 'nth': t.nth}}, (t.nth, -length(g.name), g.gaz_id)) AS hit FROM t JOIN g ON contains(' ' || t.key || ' ', ' ' || g.name || ' ') GROUP BY t.ord)
SELECT r.ord, h.hit.city AS city, h.hit.lat AS lat, h.hit.lng AS lng, CASE WHEN virtual THEN 'virtual' WHEN h.ord IS NOT NULL THEN 'city' ELSE 'unknown' END AS precision,
 CASE WHEN virtual THEN 'location.virtual' ELSE ['address.city', 'org.city', 'address.full', 'org_name'][h.hit.nth + 1] END AS resolved_from FROM r LEFT JOIN h ON r.ord = h.ord""")
def gazetteer_resolve(spark: SparkSession, d: str) -> DataFrame:
    return places.resolved(_listings(spark, d), table(spark, d, "gazetteer"), table(spark, d, "orgs"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (geo.precision = 'city') AS located, count(*) FILTER (coalesce(is_virtual, false)) AS virtual_rows, (100 * count(*) FILTER (geo.precision = 'city')) // count(*) AS percent
FROM {LISTINGS} WHERE status IS DISTINCT FROM 'inactive'""")
def geo_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).where("status is distinct from 'inactive'")
    got = rows.agg(F.count("*").alias("n"), F.count_if(F.col("geo.precision") == "city").alias("located"), F.count_if(F.coalesce("is_virtual", F.lit(False))).alias("virtual_rows"))
    return got.select("*", F.expr("(100 * located) div n").alias("percent"))


@query(f"SELECT v.ord, coalesce(nullif(v.address.city, ''), o.city) AS city, coalesce(nullif(v.address.state, ''), o.state) AS state FROM {LISTINGS} v LEFT JOIN orgs o ON v.org_id = o.id")
def org_city_backfill(spark: SparkSession, d: str) -> DataFrame:
    return places.with_home(_listings(spark, d), table(spark, d, "orgs"))


@query(f"SELECT ord, {CLEAN_CITY} AS cleaned, {TOWN} AS town FROM {LISTINGS}")
def clean_city(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", clean_town(F.col("address.city")).alias("cleaned"), places.town().alias("town"))


_HOME, _AWAY = r"(?i)\bTX\b|\bTexas\b", r"(?i)\bBarn\b|\bKiln\b"


@query(f"""WITH x AS (SELECT ord, coalesce(opportunity_title, '') AS t, trim(concat_ws(' ', nullif(address."full", ''), nullif(address.city, ''), nullif(address.state, ''))) AS w FROM {LISTINGS})
SELECT ord FROM x WHERE CASE WHEN regexp_matches(t, '{_AWAY}') AND NOT regexp_matches(t, '{_HOME}') THEN false WHEN w = '' THEN true ELSE regexp_matches(w, '{_HOME}') END""")
def region_filter(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).where(places.at_home(_HOME, _AWAY)).select("ord")


_MILES = "2 * 3958.8 * asin(sqrt(pow(sin(radians({lat} - 40.5) / 2), 2) + cos(radians(40.5)) * cos(radians({lat})) * pow(sin(radians({lng} + 38.5) / 2), 2)))"


@query(f"""SELECT ord, round({_MILES.format(lat='geo.lat', lng='geo.lng')}, 6) AS miles FROM {LISTINGS} WHERE geo.precision = 'city' ORDER BY 2, ord LIMIT 50""")
def haversine_nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).where("geo.precision = 'city'").select("ord", F.round(miles(F.col("geo.lat"), F.col("geo.lng"), 40.5, -38.5), 6).alias("miles"))
    return rows.orderBy("miles", "ord").limit(50)


@query(f"""SELECT ord, miles, row_number() OVER (ORDER BY miles NULLS LAST, ord) AS rank FROM (SELECT ord, CASE WHEN geo.precision = 'city' THEN round({_MILES.format(lat='geo.lat', lng='geo.lng')}, 6) END AS miles FROM {LISTINGS})""")
def nearest_order(spark: SparkSession, d: str) -> DataFrame:
    """Every listing, the nearest first; those without a town's coordinates come last."""
    away = F.round(miles(F.col("geo.lat"), F.col("geo.lng"), 40.5, -38.5), 6)
    rows = _listings(spark, d).select("ord", F.when(F.col("geo.precision") == "city", away).alias("miles"))
    return expiry.in_order(F.asc_nulls_last("miles"), F.col("ord"))(rows).select("ord", "miles", "rank")


@query(f"""SELECT city, {_MILES.format(lat='lat', lng='lng')} <= 60 AS near FROM gazetteer""")
def within_radius(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gazetteer").select("city", (miles(F.col("lat"), F.col("lng"), 40.5, -38.5) <= 60).alias("near"))


@query(f"""SELECT city, arg_min(lat, ord) AS lat, arg_min(lng, ord) AS lng, count(*) AS n FROM (SELECT ord, {TOWN} AS city, geo.lat AS lat, geo.lng AS lng FROM {LISTINGS} WHERE geo.precision = 'city' AND geo.lat IS NOT NULL AND geo.lng IS NOT NULL) WHERE city IS NOT NULL GROUP BY city""")
def city_centroids(spark: SparkSession, d: str) -> DataFrame:
    return places.centroids(_listings(spark, d))


@query("""SELECT city, row_number() OVER (ORDER BY k)::int AS rank FROM (SELECT lower(trim(city)) AS k, arg_min(city, gaz_id) AS city FROM gazetteer GROUP BY 1)""")
def gazetteer_build(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    towns = table(spark, d, "gazetteer").groupBy(F.lower(F.trim("city")).alias("k")).agg(F.min_by("city", "gaz_id").alias("city"))
    return towns.select("city", F.row_number().over(Window.orderBy("k")).alias("rank"))  # a list of some hundred towns
