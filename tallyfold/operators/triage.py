"""Coverage, blocklists and the triage of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import body_name
from tallyfold.functions.web import host
from tallyfold.storage import materialize

REASONS = ("no_domain", "blocklisted", "ledgered", "covered", "keep")


def suffixes(domain: Column) -> Column:
    """A domain and every domain it lies under."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def blocked(rows: DataFrame, domain: str, blocklist: DataFrame) -> DataFrame:
    """The distinct domains that are on the list or lie under one that is: an equality join on suffixes."""
    names = rows.where(f"{domain} <> ''").select(F.col(domain).alias("domain")).distinct()
    return names.select("domain", F.explode(suffixes(F.col("domain"))).alias("s")).join(blocklist.select(F.col("domain").alias("s")).distinct(), "s", "left_semi").select("domain").distinct()


def known_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The names of ``asked`` (name) that equal a name of ``known`` (name), contain one, or lie within one.

    Containment is found by an equality join: the contained name names its rarest run of three letters, and only
    names with that run are compared. Works on distinct names that are not empty."""
    a, k = (x.where("name <> ''").select("name").distinct() for x in (asked, known))

    def grams(n: Column) -> Column:
        return F.array_distinct(F.flatten(F.array(*[F.transform(F.when(F.length(n) >= q, F.sequence(F.lit(1), F.length(n) - q + 1)).otherwise(F.array().cast("array<int>")), _piece(n, q)) for q in (1, 2, 3)])))

    def _piece(n: Column, q: int):
        return lambda i: F.substring(n, i, q)

    # each side is read once: names with their side, then their grams, are written
    sided = a.withColumn("mine", F.lit(True)).unionByName(k.withColumn("mine", F.lit(False))).groupBy("name").agg(F.bool_or("mine").alias("asked"), F.bool_or(~F.col("mine")).alias("known"))
    both = materialize(sided.select("name", "asked", "known", F.explode(grams(F.col("name"))).alias("g")), "grams")
    often = both.groupBy("g").agg(F.count("*").alias("df"))
    full = both.where(F.length("g") == F.least(F.length("name"), F.lit(3))).join(often, "g")
    rarest = full.groupBy("name", "asked", "known").agg(F.min_by("g", F.struct("df", "g")).alias("g"))
    has = both.select("g", F.col("name").alias("whole"), F.col("asked").alias("whole_asked"), F.col("known").alias("whole_known"))
    met = rarest.join(has, "g").where("contains(whole, name)")
    pairs = met.select(F.explode(F.array(F.when(F.col("known") & F.col("whole_asked"), F.col("whole")), F.when(F.col("asked") & F.col("whole_known"), F.col("name")))).alias("name"))
    return pairs.where("name is not null").distinct()


def triaged(candidates: DataFrame, blocklist: DataFrame, ledger: DataFrame, known_domains: DataFrame, known: DataFrame) -> DataFrame:
    """(id, domain, reason): the first reason that applies to a candidate (id, name, url), in the order of REASONS."""
    c = candidates.select("id", body_name(F.col("name")).alias("name"), host(F.col("url")).alias("domain"))

    def flagged(rows: DataFrame, on: str, flag: str) -> DataFrame:
        return rows.select(F.col(rows.columns[0]).alias(on)).distinct().withColumn(flag, F.lit(True))

    c = c.join(flagged(blocked(c, "domain", blocklist), "domain", "b"), "domain", "left").join(flagged(ledger.select("domain"), "domain", "l"), "domain", "left")
    c = c.join(flagged(known_domains.select("domain"), "domain", "d"), "domain", "left").join(flagged(known_names(c, known), "name", "n"), "name", "left")
    reason = F.when(F.col("domain") == "", REASONS[0]).when(F.col("b"), REASONS[1]).when(F.col("l"), REASONS[2]).when(F.col("d") | F.col("n"), REASONS[3]).otherwise(REASONS[4])
    return c.select("id", "domain", reason.alias("reason"))


def funnel(triage: DataFrame, samples: int = 8) -> DataFrame:
    """(reason, n, samples): counts and the first few domains of each reason; ranks limit before anything is gathered."""
    triage = materialize(triage, "triage")
    counts = triage.groupBy("reason").agg(F.count("*").alias("n"))
    few = triage.where("domain <> ''").select("reason", "domain").distinct().withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy("domain"))).where(F.col("r") <= samples)
    shown = few.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("domain")), "|").alias("samples"))
    return counts.join(shown, "reason", "left").select("reason", "n", F.coalesce("samples", F.lit("")).alias("samples"))


def accepted(verdicts: DataFrame, threshold: float = 0.6, most: int = 10) -> DataFrame:
    """The accepted entries with enough confidence, most confident first, ties by id."""
    return verdicts.where((F.col("decision") == "accept") & (F.col("confidence") >= threshold)).orderBy(F.desc("confidence"), "id").limit(most)


def rotated(names: DataFrame, order: str, month: int, step: int, most: int) -> DataFrame:
    """A short list, starting at a place that moves on with the month, the first ``most`` of it."""
    n = names.count()
    placed = names.withColumn("pos", F.row_number().over(Window.orderBy(order)) - 1)
    turned = F.pmod(F.col("pos") - (month * step) % max(1, n), F.lit(max(1, n)))
    return placed.withColumn("turn", turned).orderBy("turn").limit(most).drop("pos")
