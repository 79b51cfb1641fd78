"""From two snapshots to index entries: merge, deduplicate, expire, tag, place, index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import corpus, dedup, expiry, merge, places
from tallyfold.storage import materialize


def rejected(listings: DataFrame, today: str) -> DataFrame:
    """(ord, category): every row a rule takes out, the first rule that does: duplicates within a source, across sources, expired."""
    inside = dedup.within_source(listings).select("ord", F.lit(1).alias("nth"), F.lit("duplicate").alias("category"))
    left = listings.join(inside.select("ord"), "ord", "left_anti")
    across = dedup.across_sources(left).select("ord", F.lit(2).alias("nth"), F.lit("duplicate").alias("category"))
    gone = listings.where(expiry.expired(today)).select("ord", F.lit(3).alias("nth"), F.lit("expired").alias("category"))
    return inside.unionByName(across).unionByName(gone).groupBy("ord").agg(F.min_by("category", "nth").alias("category"))


def curated(old: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """The rows of both snapshots that survive: bodies' new rows replace old ones, duplicates and expired rows go."""
    rows = merge.replace_bodies(old, new).select("ord")
    both = old.unionByName(new.select(*old.columns)).join(rows, "ord", "left_semi")
    return both.join(rejected(both, today).select("ord"), "ord", "left_anti")


def indexed(old: DataFrame, new: DataFrame, gazetteer: DataFrame, bodies: DataFrame, today: str) -> DataFrame:
    """Index entries of the surviving rows, placed by the gazetteer."""
    rows = materialize(curated(old, new, today), "curated")  # read three times below
    placed = places.resolved(rows, gazetteer, bodies).select("ord", F.struct(F.col("city"), F.lit("TX").alias("state"), "lat", "lng", "precision", "resolved_from").alias("placed"))
    return corpus.entries(materialize(rows.drop("geo").join(placed, "ord").withColumnRenamed("placed", "geo"), "placed"))
