"""When listings end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions import dates
from tallyfold.functions.text import squeezed
from tallyfold.storage import materialize


def rule_kind() -> tuple[Column, Column]:
    """(kind, ends_on) that the schedule alone decides; null where it does not."""
    ends = dates.named_day(F.col("schedule.date")).cast("string")
    recurring = F.col("schedule.recurring")
    return F.when(recurring, F.lit("ongoing")).when((~recurring) & ends.isNotNull(), F.lit("one_time")), F.when(~recurring, ends)


def expired(today: str) -> Column:
    """Alive, with an end before today; the dates compare as text."""
    return ~F.col("status").eqNullSafe("inactive") & (F.col("expiry.ends_on") < today)


def is_event() -> Column:
    """A single occurrence with any date."""
    return (F.col("expiry.kind") == "one_time") & (F.coalesce(F.col("expiry.ends_on"), F.lit("")) != "")


def event_date() -> Column:
    """The date of a single occurrence, if it is written as one."""
    return F.when((F.col("expiry.kind") == "one_time") & F.col("expiry.ends_on").rlike(dates.ISO_DAY), F.col("expiry.ends_on"))


def settled(kind: Column, ends_on: Column) -> tuple[Column, Column]:
    """A model's answer made safe: malformed dates dropped, unknown kinds and undated single occurrences unknown."""
    end = F.when(ends_on.rlike(dates.ISO_DAY), ends_on)
    known = F.when(kind.isin("one_time", "ongoing", "unknown"), kind).otherwise(F.lit("unknown"))
    return F.when((known == "one_time") & end.isNull(), F.lit("unknown")).otherwise(known), end


def seen_since(micros: int) -> Column:
    """Last seen at or after an instant; what names no instant was never seen."""
    return F.coalesce(dates.epoch_micros(F.col("last_scraped")), F.lit(0)) >= micros


def collapsed(listings: DataFrame) -> DataFrame:
    """Occurrences of one listing as one row: earliest date, whether it recurs, on which weekdays, the first row's tags.

    Groups reduce by partial aggregation; the weekdays are at most seven."""
    day = dates.any_day(F.col("schedule.date"))
    rows = listings.select("ord", squeezed(F.col("org_name")).alias("body"), squeezed(F.col("opportunity_title")).alias("title"), day.alias("day"), "cause_tags").where("title <> ''")
    first = F.struct(F.coalesce(F.col("day"), F.lit("9999-12-31").cast("date")), F.col("ord"))
    weekday = F.weekday("day")
    g = rows.groupBy("body", "title").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.sort_array(F.collect_set(weekday)).alias("days"), F.min_by("ord", first).alias("first_ord"), F.min_by("cause_tags", first).alias("tags"))
    return g.select(
        "first_ord", "n", (F.col("n") > 1).alias("recurring"), F.col("first_day").cast("string").alias("first_day"),
        F.when(F.col("n") > 1, dates.weekday_label(F.col("days"))).alias("weekdays"),
        F.array_join(F.array_distinct(F.array_compact("tags")), "|").alias("tags"),
    )


def in_order(*order: Column):
    """All rows with their rank in a global order: a range sort, then each part's ranks start behind the parts before it.

    The sorted rows are written once, as a second sort might cut the parts elsewhere; parts are as many as the shuffle's."""

    def run(df: DataFrame) -> DataFrame:
        placed = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "order")
        part = F.shiftright("_at", 33)
        before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")
        starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).select("_part", before.alias("_before"))
        ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
        return ranked.withColumn("rank", F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_at", "_part", "_before")

    return run


def latest_first(limit: int, *order: Column):
    """A global top list: one sorted limit, then ranks over the few rows left."""

    def run(df: DataFrame) -> DataFrame:
        return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))

    return run
