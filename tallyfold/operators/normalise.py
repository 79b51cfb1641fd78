"""Bringing records of several shapes into one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import blank_as_null, clipped, one_spaced

#: What frames a description and a location on listing pages, what shows that a block is none, and what shows an
#: address. Fixed patterns.
DESCRIPTION_MARKER = r"(?is)^.*?Opportunity Description"
DESCRIPTION_TAIL = r"(?is)\s*(?:Details\s+|Calendar\s+)?Get Connected Icon.*$|\s*Respond(?: as Team| Share)\b.*$"
LOCATION_LEAD = r"(?i)^(?:\s*(?:Location|Dot|Shift)\b)+"
NOT_AN_ADDRESS = r"(?i)Get Connected Icon|Calendar|\bUntil\b|\bongoing\b|Respond"
ADDRESS_SIGN = r"(?i)\b\d{5}\b|\bTX\b|\b(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Dr|Drive|Pkwy|Parkway|Ln|Lane|Way|Suite|Ste|Hwy|Highway|Ct|Court|Cir|Circle)\b"


def absolute(url: Column, base: str) -> Column:
    """A path put behind a base; full addresses stay, empty ones become null."""
    return F.when(url.startswith("http"), url).when(url != "", F.concat(F.lit(base), url))


def of_language(m: Column, language: str = "en") -> Column:
    """The value of a language, else the first value of a map."""
    return F.coalesce(F.try_element_at(m, F.lit(language)), F.try_element_at(F.map_values(m), F.lit(1)))


def iso_of_seconds(c: Column) -> Column:
    """Seconds since 1970 as ISO text in UTC; null unless above zero. The arithmetic does not ask the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86400).cast("int"))
    rest = F.pmod(c, F.lit(86400))
    clock = F.concat_ws(":", *[F.lpad(F.floor(x).cast("string"), 2, "0") for x in (rest / 3600, (rest % 3600) / 60, rest % 60)])
    return F.when(c > 0, F.concat(day.cast("string"), F.lit("T"), clock, F.lit("+00:00")))


def clean_description(c: Column) -> Column:
    """What stands between the description's heading and the page's controls."""
    return blank_as_null(one_spaced(F.regexp_replace(one_spaced(F.regexp_replace(c, DESCRIPTION_MARKER, "")), DESCRIPTION_TAIL, "")))


def clean_location(c: Column) -> Column:
    """A street address without the labels before it; null if the block is none."""
    t = F.trim(F.regexp_replace(one_spaced(c), LOCATION_LEAD, ""))
    return F.when(~t.rlike(NOT_AN_ADDRESS) & t.rlike(ADDRESS_SIGN), t)


def after_label(text: Column, label: str) -> Column:
    """The first line that is not blank after the first line that starts with a label."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).startswith(label.lower())), True)
    return F.when(at > 0, F.try_element_at(lines, (at + 1).cast("int")))


def city_state_zip(c: Column) -> Column:
    """(city, state, zip) of ``City, ST 00000``."""
    p = r"([A-Za-z .'-]+),\s*([A-Z]{2}),?\s*(\d{5})"
    return F.struct(*[blank_as_null(F.trim(F.regexp_extract(c, p, i))).alias(n) for i, n in ((1, "city"), (2, "state"), (3, "zip"))])


def hits(raw: DataFrame, json: str, base: str) -> DataFrame:
    """(id, org_name, title, url, short): records of a search service, given as JSON, in the listings' shape."""

    def f(*names: str) -> Column:
        return F.coalesce(*[blank_as_null(F.get_json_object(json, f"$.{n}")) for n in names])

    key = f("objectID", "id", "slug")
    title = F.coalesce(f("opportunity_title", "name", "title"), F.lit("Untitled"))
    return raw.select(key.alias("id"), f("org_name", "orgName", "organization.name").alias("org_name"), title.alias("title"), absolute(F.concat(F.lit("/need/"), key), base).alias("url"), clipped(title, 30).alias("short"))


def as_contacts(c: Column, kind: str) -> Column:
    """Contacts given as one struct or as an array of them, as an array."""
    return c if kind == "array" else F.when(c.isNotNull(), F.array(c))


def parsed_json(c: Column, schema: str) -> Column:
    """A model's reply as a value: code fences off, anything that does not parse as null."""
    body = F.regexp_replace(F.trim(c), r"(?is)^```(?:json)?\s*|\s*```$", "")
    return F.from_json(body, schema, {"mode": "PERMISSIVE"})


def tags_from_text(c: Column, allowed: tuple[str, ...]) -> Column:
    """Comma-separated tags trimmed, and kept if they are allowed, in order."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.isin(*allowed))
