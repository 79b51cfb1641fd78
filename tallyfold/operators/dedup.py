"""Exact duplicates by normalised keys, within and across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import blank_as_null, first_filled, squeezed

#: How much a source is trusted when sources repeat each other; unlisted ones come last. Fixed values.
SOURCE_TIERS = {"curated": 0, "volunteergarland": 1, "volunteermckinney": 1, "dallasdoinggood": 1, "idealist": 2, "voly_dallas": 2}
LAST_TIER = 3
TEXTS = ("id", "source", "source_url", "org_id", "org_name", "org_url", "opportunity_title", "description_short", "description_long", "status", "last_scraped")
LISTS = ("cause_tags", "unified_tags")
OTHERS = ("is_virtual", "schedule", "address", "expiry", "geo")


def completeness() -> Column:
    """How many fields of a listing hold something; empty texts and lists hold nothing."""
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in TEXTS] + [F.coalesce(F.size(c), F.lit(0)) > 0 for c in LISTS] + [F.col(c).isNotNull() for c in OTHERS]
    total = F.lit(0)
    for f in filled:
        total = total + f.cast("int")
    return total


def schedule_signal() -> Column:
    """What tells two postings of one listing apart: the date, else the free text; null if neither says anything."""
    return F.coalesce(blank_as_null(squeezed(F.col("schedule.date"))), blank_as_null(squeezed(F.col("schedule.raw"))))


def keyed(listings: DataFrame) -> DataFrame:
    """With a 256-bit digest of the dedup key (body, title, short text or long), so that no text is shuffled."""
    text = first_filled(F.col("description_short"), F.col("description_long"))
    key = F.sha2(F.concat_ws("\x00", squeezed(F.col("org_name")), squeezed(F.col("opportunity_title")), squeezed(text)), 256)
    return listings.withColumn("dup_key", key)


def alive() -> Column:
    return ~F.col("status").eqNullSafe("inactive")


def _pairs(rows: DataFrame, by: list[str], wanted: Column, best: Column) -> DataFrame:
    """(ord, keeper_ord) of the rows that a better one of their group replaces.

    Groups are decided by an aggregation with partial steps; only the small result meets the rows again."""
    # smallest and largest tell whether there are several: no expansion of the rows for distinct counts
    same = F.min("signal").eqNullSafe(F.max("signal")).alias("one_signal")
    group = rows.groupBy(*by).agg(F.count("*").alias("n"), same, (F.min("tidy_source") < F.max("tidy_source")).alias("several_sources"), F.min_by("ord", best).alias("keeper_ord")).where((F.col("n") > 1) & F.col("one_signal") & wanted)
    return rows.select("ord", *by).join(group.select(*by, "keeper_ord"), by).where("ord <> keeper_ord").select("ord", "keeper_ord")


def within_source(listings: DataFrame) -> DataFrame:
    """Duplicates inside a source: the most complete row stays, the first of equals."""
    rows = keyed(listings).where(alive()).select("ord", "dup_key", squeezed(F.col("source")).alias("tidy_source"), schedule_signal().alias("signal"), completeness().alias("filled"))
    return _pairs(rows, ["tidy_source", "dup_key"], F.lit(True), F.struct(-F.col("filled"), F.col("ord")))


def across_sources(listings: DataFrame) -> DataFrame:
    """Duplicates that several sources carry: the most trusted source's row stays, then the most complete."""
    tier = F.coalesce(F.try_element_at(F.create_map(*[x for s, t in SOURCE_TIERS.items() for x in (F.lit(s), F.lit(t))]), F.col("tidy_source")), F.lit(LAST_TIER))
    rows = keyed(listings).where(alive()).select("ord", "dup_key", squeezed(F.col("source")).alias("tidy_source"), schedule_signal().alias("signal"), completeness().alias("filled"))
    return _pairs(rows, ["dup_key"], F.col("several_sources"), F.struct(tier, -F.col("filled"), F.col("ord")))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by partial aggregation instead of a window over whole groups."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def last_written(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page in a global order, with their rank; the rank is taken after the limit."""
    top = rows.orderBy(*order).limit(number * size)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.where(F.col("rank") > (number - 1) * size)
