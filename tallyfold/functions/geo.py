"""Places and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.text import blank_as_null, stripped

EARTH_MILES = 3958.8
#: Values that stand where a town should, and words that show that other text leaked in. Fixed values.
NO_TOWN = r"(?i)^(confidential|virtual|n/?a|none|tbd|various|multiple|online|remote|—|-)$"
LEAKED = r"(?i)\b(needed|hours?|click|brought|location|center|rd|street|st|ave|blvd|opportunity|details|view)\b"


def miles(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    """Great-circle distance from a fixed point by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + math.cos(math.radians(lat0)) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lng - lng0) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(a))


def clean_town(c: Column) -> Column:
    """A town as typed, without state; null if it is none, too long, or text that leaked in."""
    t = stripped(c)
    s = stripped(F.regexp_replace(t, r"(?i),?\s*(TX|Texas)$", ""))
    bad = t.rlike(NO_TOWN) | (F.length(s) > 25) | (F.size(F.split(s, r"\s+")) > 3) | s.rlike(LEAKED) | s.rlike(r"\d{3,}")
    return F.when(~bad, blank_as_null(s))


def town_name(known: Column, typed: Column) -> Column:
    """The resolved town if there is one, else the typed one in title case."""
    return F.coalesce(blank_as_null(known), F.initcap(F.lower(clean_town(typed))))
