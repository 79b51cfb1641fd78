"""The taxonomy of causes and the tags that listings carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.text import stripped

#: The causes a listing can be filed under. Fixed values.
TAXONOMY = ("seniors", "children", "food_security", "education", "animals", "environment", "housing", "health", "legal", "arts", "community", "crisis_support", "foster_care", "disabilities", "mental_health", "immigration", "civic", "veterans")
#: Needles of directory labels and the cause each stands for, in order. Fixed values.
LABEL_CAUSES = (
    ("animal", "animals"), ("environment", "environment"), ("conservation", "environment"), ("health", "health"), ("mental health", "mental_health"), ("education", "education"), ("youth", "children"), ("children", "children"),
    ("senior", "seniors"), ("hunger", "food_security"), ("food", "food_security"), ("housing", "housing"), ("shelter", "housing"), ("homeless", "housing"), ("arts", "arts"), ("culture", "arts"), ("human services", "community"),
    ("community", "community"), ("civic", "civic"), ("public", "civic"), ("disabilit", "disabilities"), ("veteran", "veterans"), ("military", "veterans"), ("immigrant", "immigration"), ("refugee", "immigration"), ("crisis", "crisis_support"), ("legal", "legal"), ("foster", "foster_care"),
)
#: Tags that are names of networks, and words that show a page's controls. Fixed values.
NETWORKS = ("instagram", "facebook", "twitter", "linkedin", "tiktok", "youtube", "snapchat", "pinterest", "threads")
CONTROLS = r"(?i)\b(posted by|agency|see more|sign up|click here|share opportunity|respond|calendar|icon)\b"


def taxonomy() -> Column:
    return F.array(*[F.lit(t) for t in TAXONOMY])


def known_tags(c: Column) -> Column:
    """The tags that belong to the taxonomy, in order, each once."""
    return F.array_intersect(F.coalesce(c, F.array().cast("array<string>")), taxonomy())


def tidy_tag(t: Column) -> Column:
    """A scraped tag, or null if it is blank, long, a network, a control or glued words."""
    s = stripped(t)
    ok = (s != "") & (F.length(s) <= 40) & ~F.lower(s).isin(*NETWORKS) & ~s.rlike(CONTROLS) & ~s.rlike("[a-z][A-Z]")
    return F.when(ok, s)


def tidy_tags(c: Column) -> Column:
    """Scraped tags tidied; the first of those that differ only in case."""
    tidy = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), tidy_tag), lambda x: x.isNotNull())
    lowered = F.transform(tidy, F.lower)
    return F.filter(tidy, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def tags_of(unified: Column, scraped: Column) -> Column:
    """The unified tags if a listing has any, else its scraped ones, tidied."""
    return F.when(F.size(F.coalesce(unified, F.array().cast("array<string>"))) > 0, unified).otherwise(tidy_tags(scraped))


def label_causes(label: Column) -> Column:
    """The causes a directory's label stands for; community if none is named."""
    hits = F.filter(F.array(*[F.when(F.lower(label).contains(n), F.lit(c)) for n, c in LABEL_CAUSES]), lambda x: x.isNotNull())
    found = F.array_distinct(hits)
    return F.when(F.coalesce(label, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(F.lit("community"))).otherwise(found)


def tag_label(t: Column) -> Column:
    """``food_security`` as ``Food security``."""
    s = F.replace(t, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1000))
