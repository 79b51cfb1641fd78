"""The queries of the training-data operators, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import canon, mixing, names, neardup, neighbours, packing, sentences, survivors, tokens
from tallyfold.llm.history import FingerprintStore
from tallyfold.storage import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
TEXTS = ["org_name", "opportunity_title", "description_long"]
ALIKE = 0.7  # the share of common words from which TESTDATA.md calls two rows alike


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = survivors.fuse(table(spark, sf_dir, "volops_dallasdoinggood"), table(spark, sf_dir, "source_ranks"))
    return fused.select(F.col("group_key").alias("group_ord"), F.col("source_key").alias("source_ord"), F.col("scraped_key").alias("scraped_ord"), F.col("schedule_key").alias("schedule_ord"))


def p1_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What copy-discounted votes favour, field by field, and how sure they are, for every group."""
    fused = survivors.fuse(table(spark, sf_dir, "volops_dallasdoinggood"), table(spark, sf_dir, "source_ranks"))
    return fused.select(F.col("group_key").alias("group_ord"), "n_rows", "claims", "source", "scraped", "schedule", *[F.round(f"{c}_p", 6).alias(f"{c}_p") for c in ("source", "scraped", "schedule")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history becomes a store; the batches, in their order of arrival by ord, are held against it."""
    store = FingerprintStore.create(table(spark, sf_dir, "volops_dallasdoinggood"), "ord", "id", TEXTS, "description_long", ALIKE)
    return store.ingest(table(spark, sf_dir, "volops_batches")).toDF("seen_ord", "new_ord")


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch by batch, each against all that came before it: how many pairs it gave, and how many of its rows were seen before."""
    store = FingerprintStore.create(table(spark, sf_dir, "volops_dallasdoinggood"), "ord", "id", TEXTS, "description_long", ALIKE)
    rows = table(spark, sf_dir, "volops_batches")
    batches = [r["batch_no"] for r in rows.select("batch_no").distinct().orderBy("batch_no").collect()]  # they get longer, not more
    found = None
    for n in batches:
        seen = store.ingest(rows.where(F.col("batch_no") == n), str(n)).withColumn("batch_no", F.lit(n))
        found = seen if found is None else found.unionByName(seen)
    if found is None:
        return spark.createDataFrame([], "batch_no long, n_pairs long, n_seen long")
    return found.groupBy("batch_no").agg(F.count("*").alias("n_pairs"), F.count_distinct("new_key").alias("n_seen"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "volops_dallasdoinggood")
    return neardup.near_duplicates(rows, "ord", TEXTS, "description_long", ALIKE).toDF("ord_a", "ord_b")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "volops_dallasdoinggood")
    return neardup.classes(rows, "ord", TEXTS, "description_long", ALIKE).toDF("ord", "class_ord", "n_links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variants(table(spark, sf_dir, "volops_dallasdoinggood"), "org_name")


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spelling: how many spellings its body has, and the smallest of them."""
    found = names.entities(table(spark, sf_dir, "volops_dallasdoinggood"), "org_name")
    size = found.groupBy("entity").agg(F.min("name").alias("first_name"), F.count("*").alias("n_names"))
    return found.join(size, "entity").select("name", "first_name", "n_names")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "opportunities"), "row_no", "embedding")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "gazetteer").select(F.col("gaz_id").alias("id"), F.col("city").alias("name"))
    rows = table(spark, sf_dir, "volops_dallasdoinggood")
    return canon.match_places(rows, "ord", F.col("address.city"), F.col("address.full"), entries).toDF("ord", "gaz_id")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(tokens.sized(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    return packing.packed(sizes, table(spark, sf_dir, "pack_limits")).withColumnRenamed("key", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are, and how even their costs."""
    found = packing.fill(p7_packing(spark, sf_dir), table(spark, sf_dir, "pack_limits"))
    return found.select("limit_id", "capacity_tokens", "containers", "tokens", F.round("fill", 6).alias("fill"), F.round("cost_spread", 6).alias("cost_spread"))


def _sizes_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(tokens.sized(table(spark, sf_dir, "documents"), "doc_id", "text", keep=("source",)), "sizes")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_sizes_by_source(spark, sf_dir), table(spark, sf_dir, "mix_targets")).withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares really reached."""
    sizes, targets = _sizes_by_source(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.draw(sizes, targets), sizes, targets).withColumn("actual_share", F.round("actual_share", 6))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_fused, p2_found, p2_batches, p3_found, p3_classes, p4_found, p4_entities, p5_found, p6_found, p7_packing, p7_fill, p8_mix, p8_shares, p9_found)}
