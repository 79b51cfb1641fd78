"""Facet counts, facet filters and roll-ups by body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.tags import TAXONOMY, tags_of
from tallyfold.functions.text import blank_as_null, clean_body_name, squeezed, stripped
from tallyfold.operators.expiry import is_event
from tallyfold.operators.places import town


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not inactive; a missing status passes."""
    return rows.where(~F.col("status").eqNullSafe("inactive"))


def by_source(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(source, n) of the known sources that occur, and ``all``."""
    counts = rows.groupBy(squeezed(F.col("source")).alias("source")).agg(F.count("*").alias("n"))
    return counts.where(F.col("source").isin(*known)).unionByName(rows.agg(F.lit("all").alias("source"), F.count("*").alias("n")))


def by_cause(rows: DataFrame) -> DataFrame:
    """(cause, n), causes of the taxonomy only; a row counts once for each tag it carries."""
    tags = rows.select(F.explode(tags_of(F.col("unified_tags"), F.col("cause_tags"))).alias("cause"))
    return tags.where(F.col("cause").isin(*TAXONOMY)).groupBy("cause").agg(F.count("*").alias("n"))


def by_town(rows: DataFrame, least: int = 3, most: int | None = 18) -> DataFrame:
    """(city, n) of the towns with enough rows, the most frequent ones; ties by name."""
    counts = rows.select(town().alias("city")).where("city is not null").groupBy("city").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "city").limit(most) if most else counts


def timing(rows: DataFrame) -> DataFrame:
    """(all_rows, events, ongoing): an event counts as one only."""
    event = F.coalesce(is_event(), F.lit(False))
    ongoing = F.coalesce(F.col("expiry.kind") == "ongoing", F.lit(False))
    return rows.agg(F.count("*").alias("all_rows"), F.count_if(event).alias("events"), F.count_if(ongoing & ~event).alias("ongoing"))


def chosen(sources: tuple[str, ...] = (), causes: tuple[str, ...] = (), towns: tuple[str, ...] = (), when: str | None = None) -> Column:
    """Or inside a facet, and across facets; an empty facet allows all."""
    keep = F.lit(True)
    if sources:
        keep &= squeezed(F.col("source")).isin(*sources)
    if causes:
        keep &= F.arrays_overlap(tags_of(F.col("unified_tags"), F.col("cause_tags")), F.array(*map(F.lit, causes)))
    if towns:
        keep &= town().isin(*towns)
    if when == "events":
        keep &= is_event()
    elif when == "ongoing":
        keep &= F.col("expiry.kind") == "ongoing"
    return keep


def body_key(c: Column) -> Column:
    return F.lower(clean_body_name(c))


def bodies(rows: DataFrame) -> DataFrame:
    """(key, name, n, causes, cities, sources, url) of each body, causes by frequency.

    Tags, towns and sources are counted in steps that reduce before they gather: what is gathered for a body is its
    distinct values, not its rows, so a body with a third of all rows is no hot group."""
    r = rows.select("ord", clean_body_name(F.col("org_name")).alias("name"), body_key(F.col("org_name")).alias("key"), tags_of(F.col("unified_tags"), F.col("cause_tags")).alias("tags"), town().alias("city"), squeezed(F.col("source")).alias("source"), blank_as_null(F.col("org_url")).alias("url")).where("key is not null")
    main = r.groupBy("key").agg(F.min_by("name", "ord").alias("name"), F.count("*").alias("n"), F.min_by("url", F.when(F.col("url").isNotNull(), F.col("ord"))).alias("url"))
    tags = r.select("key", F.explode("tags").alias("tag")).where(F.col("tag").isin(*TAXONOMY)).groupBy("key", "tag").agg(F.count("*").alias("m"))
    tags = tags.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "tag"))), lambda x: x["tag"]), "|").alias("causes"))

    def values(column: str) -> DataFrame:
        return r.where(f"{column} <> ''").select("key", column).distinct().groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(column)), "|"))

    out = main.join(tags, "key", "left").join(values("city").toDF("key", "cities"), "key", "left").join(values("source").toDF("key", "sources"), "key", "left")
    return out.select("key", "name", "n", "url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("causes", "cities", "sources")])


def index_bodies(rows: DataFrame) -> DataFrame:
    """(key, n, causes, cities) of bodies for the search index: trimmed lower names, raw tags where none are unified."""
    tags = F.when(F.size(F.coalesce("unified_tags", F.array().cast("array<string>"))) > 0, F.col("unified_tags")).otherwise(F.coalesce("cause_tags", F.array().cast("array<string>")))
    r = rows.select(F.lower(stripped(F.col("org_name"))).alias("key"), tags.alias("tags"), town().alias("city")).where("key <> ''")
    counts = r.groupBy("key").agg(F.count("*").alias("n"))
    causes = r.select("key", F.explode("tags").alias("t")).distinct().groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("t")), "|").alias("causes"))
    cities = r.where("city is not null").select("key", "city").distinct().groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("city")), "|").alias("cities"))
    return counts.join(causes, "key", "left").join(cities, "key", "left").select("key", "n", F.coalesce("causes", F.lit("")).alias("causes"), F.coalesce("cities", F.lit("")).alias("cities"))
