"""Mixing sources to target weights (problem 8) by weighted sampling without replacement, epoch by epoch.

Each mix names sources, the share of all tokens each shall supply and how often a document may be used at
most. The mix is made as large as these allow: its total is the smallest, over its sources, of what the source
can supply divided by its share. Sources without a token supply nothing; their share goes to the others in
proportion and the report shows what was reached.

A source's budget is whole epochs, each taking every document once, and a rest below one epoch. For the rest
every document draws an exponential key -ln(u) / weight (Efraimidis and Spirakis), u from a hash of seed, mix
and document, so that a run is repeatable and documents of higher quality come earlier; the keys are sorted
within the source and sizes summed up to the budget. What is missing to it then goes to the one further document
whose size comes nearest.

The sums run in two steps, so that no task sorts a whole source: keys fall into buckets of a few thousand
documents, bucket totals are summed up first, and only then the documents of a bucket. A source holding a third
of all documents thus takes a third of the buckets.

Source names are compared without case and outer blanks; null names and documents without tokens are left out.
A mix that names a source twice counts the shares together, with the smaller cap. Shares, caps or ids that are null
or not above zero give no row in the draw. Equal keys: the smaller document id. Empty input: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.storage import materialize

BUCKET = 8192  # documents of a source that are sorted together, about


def _name(c: Column) -> Column:
    return F.lower(F.trim(c))


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, n_docs, available, budget): what each source has and shall give."""
    wanted = targets.select("mix_id", _name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("cap")).where("mix_id is not null and source <> '' and share > 0 and cap > 0")
    wanted = wanted.groupBy("mix_id", "source").agg(F.sum("share").alias("target_share"), F.min("cap").alias("max_repeats"))
    have = sizes.where("n_tokens > 0").groupBy(_name(F.col("source")).alias("source")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("available"))
    both = wanted.join(have, "source", "left").fillna(0, ["n_docs", "available"])
    mix = Window.partitionBy("mix_id")  # a mix's sources: a short list
    here = F.when(F.col("available") > 0, F.col("target_share"))
    share = here / F.sum(here).over(mix)
    total = F.min(F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / share)).over(mix)
    return both.select("mix_id", "source", "target_share", "max_repeats", "n_docs", "available", F.coalesce(total * share, F.lit(0.0)).alias("budget"))


def draw(sizes: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(mix_id, source, key, n_tokens, copies): the documents of each mix and how often each is used.

    sizes: (key, source, n_tokens, quality), a written table."""
    plan = materialize(budgets(sizes, targets), "budgets").where("budget > 0")
    # at most the cap; the nearest whole number where the budget is a multiple up to rounding
    epochs = F.least(F.floor(F.col("budget") / F.col("available") + 1e-9), F.col("max_repeats"))
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("available")))
    docs = sizes.where("n_tokens > 0").select("key", _name(F.col("source")).alias("source"), "n_tokens", "quality")
    rows = docs.join(plan.select("mix_id", "source", "epochs", "rest", "max_repeats", "n_docs"), "source")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "key"), 11) + 0.5) / float(1 << 53)
    rows = rows.withColumn("draw", -F.log(u) / F.col("quality"))
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET))
    rows = rows.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("draw"))) * n_buckets), n_buckets - 1).cast("long"))
    part = rows.groupBy("mix_id", "source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("mix_id", "source").orderBy("bucket")) - F.col("in_bucket")
    offsets = part.select("mix_id", "source", "bucket", before.alias("before"))
    rows = rows.join(offsets, ["mix_id", "source", "bucket"])
    order = Window.partitionBy("mix_id", "source", "bucket").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.col("epochs") < F.col("max_repeats"))
    rows = rows.withColumn("taken", F.col("open") & (F.col("before") + F.sum("n_tokens").over(order) <= F.col("rest")))
    ranked = materialize(rows.select("mix_id", "source", "key", "n_tokens", "draw", "epochs", "rest", "open", "taken"), "ranked")
    # what the sum stopped short of goes to the one further document that fills it best, if that comes nearer
    short = ranked.groupBy("mix_id", "source").agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("taken"), F.col("n_tokens"))), F.lit(0))).alias("gap"))
    left = ranked.where("open and not taken").join(short, ["mix_id", "source"]).where("n_tokens < 2 * gap")
    last = left.groupBy("mix_id", "source").agg(F.min_by("key", F.struct(F.abs(F.col("n_tokens") - F.col("gap")), "draw", "key")).alias("last"))
    copies = F.col("epochs").cast("long") + (F.col("taken") | F.coalesce(F.col("key") == F.col("last"), F.lit(False))).cast("long")
    return ranked.join(last, ["mix_id", "source"], "left").select("mix_id", "source", "key", "n_tokens", copies.alias("copies")).where("copies > 0")


def shares(drawn: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, available, n_docs, tokens, most_copies, actual_share)."""
    got = drawn.groupBy("mix_id", "source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    plan = budgets(sizes, targets).drop("n_docs")
    both = plan.join(got, ["mix_id", "source"], "left").fillna(0, ["n_docs", "tokens", "most_copies"])
    actual = F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("mix_id")))
    return both.select("mix_id", "source", "target_share", "max_repeats", "available", "n_docs", "tokens", "most_copies", F.coalesce(actual, F.lit(0.0)).alias("actual_share"))
