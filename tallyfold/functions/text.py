"""Text normalisation, slugs, clipping and pattern extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, no-break and other Unicode spaces included.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: How addresses and telephone numbers look in listings. Fixed patterns.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}"
#: Words that legal forms add to a body's name. Fixed values.
LEGAL_WORDS = ("inc", "incorporated", "foundation", "fund", "organization", "org", "association", "assoc", "society", "charities", "charitie", "charity", "ministries", "ministry", "llc")
#: What listing pages leave behind a name. Fixed values.
NAME_NOISE = r"(?i)\s*(Posted By|Agency|Brought To You By|Get Connected)\s*$"


def blank_as_null(c: Column) -> Column:
    """Truthiness of texts: the empty string falls through to the next choice."""
    return F.nullif(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[blank_as_null(c) for c in cs])


def squeezed(c: Column) -> Column:
    """Lower case, runs of white space as one space, none outside, null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{SPACE}+", " "))


def one_spaced(c: Column) -> Column:
    """Runs of white space as one space, none outside; null stays null."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def stripped(c: Column) -> Column:
    """Without white space at the ends, no-break spaces included."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def match_key(c: Column) -> Column:
    """Lower-case letters and digits with one space between: the key places are matched by."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def body_name(c: Column) -> Column:
    """A body's name without article, legal words and punctuation."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    s = F.regexp_replace(s, r"\bthe\b", " ")
    s = F.regexp_replace(s, rf"\b({'|'.join(LEGAL_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clean_body_name(c: Column) -> Column:
    """The display name: up to three trailing labels taken off, blank as null."""
    t = stripped(c)
    for _ in range(3):
        t = stripped(F.regexp_replace(t, NAME_NOISE, ""))
    return blank_as_null(t)


def slug(c: Column, joiner: str = "-") -> Column:
    """Lower case with white space as a joiner."""
    return F.regexp_replace(F.lower(c), r"\s+", joiner)


def id_slug(c: Column) -> Column:
    """Lower-case letters and digits joined by underscores."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def clipped(c: Column, n: int = 200) -> Column:
    """At most n characters, cut before the last word begun, with an ellipsis; empty as null."""
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(F.substring(c, 1, n), " [^ ]*$", ""), F.lit("…"))).when(F.length(c) > 0, c)


def emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0))


def phones(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PHONE), F.lit(0))


def spoken_number(c: Column) -> Column:
    """The first whole number of a text, thousands separated by commas."""
    return F.regexp_replace(blank_as_null(F.regexp_extract(c, r"\d[\d,]*", 0)), ",", "").try_cast("long")


def score_bar(n: Column, width: int = 5) -> Column:
    """A bar of filled and empty dots."""
    return F.concat(F.repeat(F.lit("●"), F.least(n, F.lit(width)).cast("int")), F.repeat(F.lit("○"), F.greatest(F.lit(width) - n, F.lit(0)).cast("int")))
