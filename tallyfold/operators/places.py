"""Resolving where a listing takes place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.geo import town_name
from tallyfold.functions.text import blank_as_null, match_key


def resolved(listings: DataFrame, gazetteer: DataFrame, bodies: DataFrame) -> DataFrame:
    """(ord, city, lat, lng, precision, resolved_from): the first of address.city, the body's city, address.full and the
    body's name that contains a gazetteer name as whole words, the longest such name, the first of equals; virtual listings have no place.

    Containment is an equality join: the distinct candidate texts give their runs of words, up to as many words as
    the longest name has, and these meet the names. No pair of a text and a name that it lacks is ever formed."""
    towns = gazetteer.select(match_key(F.col("city")).alias("name"), "city", "lat", "lng", "gaz_id").where("name <> ''")
    homes = bodies.select(F.col("id").alias("org_id"), F.col("city").alias("home"))
    rows = listings.select("ord", "org_id", "org_name", F.coalesce("is_virtual", F.lit(False)).alias("virtual"), F.col("address.city").alias("c1"), F.col("address.full").alias("c3")).join(homes, "org_id", "left")
    named = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(s).alias("source"), match_key(c).alias("key")) for i, (s, c) in enumerate((("address.city", F.col("c1")), ("org.city", F.col("home")), ("address.full", F.col("c3")), ("org_name", F.col("org_name"))))])
    tried = rows.where("not virtual").select("ord", F.explode(named).alias("t")).select("ord", "t.*").where("key <> ''")
    longest = towns.agg(F.max(F.size(F.split("name", " "))).alias("n")).first()["n"] or 1
    words = F.split("key", " ")

    def runs_of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    runs = [runs_of(n) for n in range(1, longest + 1)]
    hits = tried.select("key").distinct().select("key", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("name")).join(towns, "name")
    best = hits.groupBy("key").agg(F.min_by(F.struct("city", "lat", "lng"), F.struct(-F.length("name"), F.col("gaz_id"))).alias("town"))
    first = tried.join(best, "key").groupBy("ord").agg(F.min_by(F.struct("town", "source"), "nth").alias("hit"))
    placed = rows.join(first, "ord", "left")
    return placed.select(
        "ord", F.col("hit.town.city").alias("city"), F.col("hit.town.lat").alias("lat"), F.col("hit.town.lng").alias("lng"),
        F.when(F.col("virtual"), F.lit("virtual")).when(F.col("hit").isNotNull(), F.lit("city")).otherwise(F.lit("unknown")).alias("precision"),
        F.when(F.col("virtual"), F.lit("location.virtual")).otherwise(F.col("hit.source")).alias("resolved_from"),
    )


def with_home(listings: DataFrame, bodies: DataFrame) -> DataFrame:
    """(ord, city, state): a listing's own town and state, else its body's."""
    homes = bodies.select(F.col("id").alias("org_id"), F.col("city").alias("home"), F.col("state").alias("home_state"))
    rows = listings.select("ord", "org_id", F.col("address.city").alias("c"), F.col("address.state").alias("s")).join(homes, "org_id", "left")
    return rows.select("ord", F.coalesce(blank_as_null(F.col("c")), "home").alias("city"), F.coalesce(blank_as_null(F.col("s")), "home_state").alias("state"))


def town() -> Column:
    return town_name(F.col("geo.city"), F.col("address.city"))


def at_home(home: str, elsewhere: str) -> Column:
    """Whether a listing belongs to the region: a title that names only places elsewhere speaks against it; without any
    address it does; else the address must match."""
    title = F.coalesce("opportunity_title", F.lit(""))
    where = F.trim(F.concat_ws(" ", *[blank_as_null(F.col(f"address.{c}")) for c in ("full", "city", "state")]))
    return F.when(title.rlike(elsewhere) & ~title.rlike(home), False).when(where == "", True).otherwise(where.rlike(home))


def centroids(listings: DataFrame) -> DataFrame:
    """(city, lat, lng, n): the first coordinates of each town and how many listings have some."""
    rows = listings.select("ord", town().alias("city"), "geo").where("city is not null and geo.precision = 'city' and geo.lat is not null and geo.lng is not null")
    return rows.groupBy("city").agg(F.min_by("geo.lat", "ord").alias("lat"), F.min_by("geo.lng", "ord").alias("lng"), F.count("*").alias("n"))
