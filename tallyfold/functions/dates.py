"""Dates and times written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


def named_day(c: Column) -> Column:
    """``Nov 4, 2026`` as a date, anything else as null."""
    return F.when(F.trim(c).rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), F.try_to_timestamp(F.trim(c), F.lit("MMM d, yyyy")).cast("date"))


def iso_day(c: Column) -> Column:
    """``2026-11-04`` as a date, anything else as null."""
    return F.when(c.rlike(ISO_DAY), c.try_cast("date"))


def any_day(c: Column) -> Column:
    return F.coalesce(iso_day(c), named_day(c))


def day_label(d: Column, year: int) -> Column:
    """``Jul 20``, with the year only where it is another than the given one."""
    return F.when(F.year(d) == year, F.date_format(d, "MMM d")).otherwise(F.date_format(d, "MMM d, yyyy"))


def epoch_micros(c: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 text or a number of seconds; null if it is neither.

    A time without zone is UTC. Independent of the session's zone: the offset is taken off by arithmetic."""
    t = F.trim(c)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?)?$")
    zone = F.regexp_extract(t, r"(Z|[+-]\d{2}:\d{2})$", 1)
    bare = F.regexp_replace(t, r"(:\d{2}(\.\d+)?)(Z|[+-]\d{2}:\d{2})$", "$1")
    offset = F.when(zone.rlike("^[+-]"), (F.substring(zone, 2, 2).try_cast("long") * 60 + F.substring(zone, 5, 2).try_cast("long")) * F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))).otherwise(F.lit(0))
    return F.when(t.rlike(r"^\d{1,12}$"), t.try_cast("long") * 1_000_000).when(iso, micros(bare.try_cast("timestamp_ntz")) - offset * 60_000_000)


def micros(ntz: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    day = F.unix_date(ntz.cast("date")).cast("long") * 86_400
    return (day + F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.second(ntz)) * 1_000_000 + F.date_format(ntz, "SSSSSS").cast("long")


def clock_minutes(c: Column) -> Column:
    """Minutes after midnight of ``1:30 PM``."""
    hour, minute = F.regexp_extract(c, r"(\d{1,2}):(\d{2})", 1).try_cast("int"), F.regexp_extract(c, r"(\d{1,2}):(\d{2})", 2).try_cast("int")
    return F.when(c.rlike(r"(?i)^\s*\d{1,2}:\d{2}\s*[AP]M\s*$"), (hour % 12) * 60 + minute + F.when(c.rlike(r"(?i)PM\s*$"), F.lit(720)).otherwise(F.lit(0)))


def clock_label(minutes: Column) -> Column:
    """``1:30 PM`` of minutes after midnight."""
    hour = F.floor(minutes / 60).cast("int")
    shown = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    return F.concat(shown.cast("string"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.when(hour >= 12, F.lit(" PM")).otherwise(F.lit(" AM")))


def weekday_label(days: Column) -> Column:
    """``Weekly on Tue, Thu & Sat`` of a sorted array of weekdays (0 is Monday); null if there is none."""
    names = F.transform(days, lambda d: F.element_at(F.array(*[F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]), d + 1))
    n = F.size(days)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    joined = F.when(n == 1, F.element_at(names, 1)).otherwise(F.concat(head, F.lit(" & "), F.element_at(names, -1)))
    return F.when(n > 0, F.concat(F.lit("Weekly on "), joined))
