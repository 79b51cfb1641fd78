"""Search corpus entries, projections for models and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import blank_as_null, first_filled, stripped
from tallyfold.operators.expiry import event_date
from tallyfold.operators.facets import index_bodies, live
from tallyfold.operators.places import town


def _tags() -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce("unified_tags", none)) > 0, F.col("unified_tags")).otherwise(F.coalesce("cause_tags", none))


def chunk() -> Column:
    """The text of a listing that is embedded: one line a fact, facts that are missing left out."""
    tags = F.array_join(_tags(), ", ")
    when = F.when(event_date().isNotNull(), F.concat(F.lit("When: "), event_date(), F.lit(" (one-time event)"))).when(F.col("expiry.kind") == "ongoing", F.lit("Availability: ongoing"))
    return F.concat_ws(
        "\n",
        blank_as_null(F.col("opportunity_title")),
        F.concat(F.lit("Organization: "), blank_as_null(F.col("org_name"))),
        F.concat(F.lit("Location: "), town()),
        F.when(F.coalesce("is_virtual", F.lit(False)), F.lit("Format: virtual / remote")),
        F.concat(F.lit("Causes: "), blank_as_null(tags)),
        when,
        first_filled(F.col("description_long"), F.col("description_short")),
    )


def entries(listings: DataFrame) -> DataFrame:
    """(id, type, city, causes, is_virtual, event_date): live listings and the bodies they name, ready to index."""
    rows = live(listings)
    own = rows.select(
        F.coalesce(blank_as_null(F.col("id")), F.concat(F.lit("listing:"), F.coalesce("opportunity_title", F.lit("")))).alias("id"), F.lit("listing").alias("type"), town().alias("city"),
        F.array_join(F.coalesce("unified_tags", F.array().cast("array<string>")), "|").alias("causes"), F.coalesce("is_virtual", F.lit(False)).alias("is_virtual"), event_date().alias("event_date"),
    )
    b = index_bodies(rows)
    bodies = b.select(F.concat(F.lit("org:"), F.col("key")).alias("id"), F.lit("organization").alias("type"), blank_as_null(F.substring_index("cities", "|", 1)).alias("city"), "causes", F.lit(False).alias("is_virtual"), F.lit(None).cast("string").alias("event_date"))
    return own.unionByName(bodies)


def for_judging(most: int = 700) -> Column:
    """What a model gets to see of a listing, as JSON with every text cut to its budget."""
    return F.to_json(F.struct("id", F.substring("org_name", 1, 200).alias("org"), F.substring("opportunity_title", 1, 200).alias("title"), F.substring(first_filled(F.col("description_long"), F.col("description_short")), 1, most).alias("description")))


def light(listings: DataFrame) -> DataFrame:
    """Listings without what cards do not show."""
    return listings.drop("description_long", "contact", "qc")


def where_label() -> Column:
    """Virtual, town and state, town, or nothing."""
    city, state = blank_as_null(stripped(F.col("address.city"))), blank_as_null(stripped(F.col("address.state")))
    return F.when(F.coalesce("is_virtual", F.lit(False)), F.lit("Virtual")).when(city.isNotNull() & state.isNotNull(), F.concat(city, F.lit(", "), state)).otherwise(city)


def when_label() -> Column:
    """The schedule's free text, else its date, else how it recurs."""
    recurs = F.when(F.col("schedule.recurring"), F.lit("recurring")).when(~F.col("schedule.recurring"), F.lit("one-time"))
    return F.coalesce(blank_as_null(F.trim(F.col("schedule.raw"))), blank_as_null(F.col("schedule.date")), recurs)


def within_budget(rows: DataFrame, group: str, order: str, text: str, each: int = 3500, total: int = 8000, lanes: int = 64) -> DataFrame:
    """(group, order, piece): the texts of a group in order, each cut to ``each``, until ``total`` characters are used up.

    A group is dealt to lanes first: what comes after ``total`` characters of its lane comes after as many of its group
    and goes. So a hot group is sorted in as many tasks, and the last step gets little more than ``total`` characters a lane."""
    cut = rows.where(F.length(text) > 0).select(group, order, F.substring(text, 1, each).alias("piece")).withColumn("lane", F.pmod(F.xxhash64(order), F.lit(lanes)))

    def before(*keys: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)).cast("int")

    some = cut.withColumn("before", before(group, "lane")).where(F.col("before") < total)
    kept = some.withColumn("before", before(group)).where(F.col("before") < total)
    return kept.select(group, order, F.substring(F.col("piece"), F.lit(1), F.lit(total) - F.col("before")).alias("piece"))
