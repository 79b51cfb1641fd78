"""Near-duplicate records with small edits (problem 3): a set-similarity self-join by bit-sliced comparison.

1. Every record becomes a set of word hashes, written once to the shared folder (``wordsets``).
2. Sets meet in blocks: rare shared words, min-wise bands over the common words (``wordsets.keys_of``).
3. Within a block the 128-bit sketches are compared bit-sliced (``bitslice``): vertical planes, carry-save
   counters, abandoned beyond the radius. The radius loses no pair that meets in the block.
4. What is left is held against the threshold with the exact word sets.
5. Sets are joined back to their records.

Copies: rows with the same word set are one set until step 5, so a hot group of copies costs a row each and no
comparison. Nulls: a null key, or a null or blank required text, takes no part; other null texts are skipped.
Empty input gives an empty result. Records longer than any other are treated alike: keys, sketch and check use
the whole text. Ties cannot arise: the result is a set of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import blocks, wordsets
from tallyfold.llm.components import components
from tallyfold.storage import materialize


def set_pairs(sets: DataFrame, threshold: float, split: int = blocks.SPLIT) -> DataFrame:
    """(a, b, shared, total): all pairs of different word sets that are alike. ``sets``: a written table."""
    spark = sets.sparkSession
    n = sets.count()
    reducers = blocks.partitions_for(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = wordsets.frequencies(sets)
    sent = blocks.postings(sets, cells, wordsets.rare_limit(n), threshold, 2, 8 * reducers)
    near = materialize(blocks.candidates(sent.repartition(reducers, "dest"), threshold, split=split).distinct(), "near")  # used three times
    return blocks.verified(near, sets, threshold)


def near_duplicates(df: DataFrame, key: str, texts: list[str], required: str, threshold: float = 0.7) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every pair of rows that are alike, copies included.

    ``key`` must be unique and integral. The result is as large as there are pairs; for groups of very many
    copies use :func:`classes`, which grows with the rows."""
    sets = materialize(wordsets.word_sets(df, key, texts, required), "wordsets")
    pairs = set_pairs(sets, threshold)
    rows = sets.select("set_id", "key")
    between = pairs.select("a", "b").join(rows.toDF("a", "ka"), "a").join(rows.toDF("b", "kb"), "b")
    inside = rows.toDF("a", "ka").join(rows.toDF("a", "kb"), "a").where("ka < kb")
    return between.select("ka", "kb").unionByName(inside.select("ka", "kb")).select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def classes(df: DataFrame, key: str, texts: list[str], required: str, threshold: float = 0.7) -> DataFrame:
    """(key, class_key, n_links): one row per row that takes part. class_key is the smallest key of its group of
    rows connected by likeness; n_links counts the other rows it is alike with. Copies are not expanded."""
    sets = materialize(wordsets.word_sets(df, key, texts, required), "wordsets")
    pairs = materialize(set_pairs(sets, threshold).select("a", "b"), "setpairs")
    groups = components(pairs)
    size = sets.groupBy("set_id").agg(F.count("*").alias("copies"), F.min("key").alias("least"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(size.select(F.col("set_id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("copies").alias("linked"))
    known = size.join(groups.select(F.col("node").alias("set_id"), "component"), "set_id", "left").join(links, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    first = known.groupBy("component").agg(F.min("least").alias("class_key"))
    known = known.join(first, "component").select("set_id", "class_key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sets.select("key", "set_id").join(known, "set_id").select("key", "class_key", "n_links")
