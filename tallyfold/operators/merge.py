"""Merging successive snapshots, ledgers and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.dedup import last_written


def merge_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, status, opportunity_title, unified_tags, expiry_kind, seen_in): the union by id. Rows of the new snapshot are active and
    win; stamps that a new row lacks are carried over; rows seen before only become inactive.

    One full outer join on the id, both sides reduced to a row an id first."""
    o = last_written(old.select("ord", "id", "opportunity_title", "unified_tags", F.col("expiry.kind").alias("kind")), "id", "ord").select("id", F.struct("opportunity_title", "unified_tags", "kind").alias("o"))
    n = last_written(new.select("ord", "id", "opportunity_title", "unified_tags", F.col("expiry.kind").alias("kind")), "id", "ord").select("id", F.struct("opportunity_title", "unified_tags", "kind").alias("n"))
    fresh = F.col("n").isNotNull()
    return o.join(n, "id", "full_outer").select(
        "id",
        F.when(fresh, F.lit("active")).otherwise(F.lit("inactive")).alias("status"),
        F.when(fresh, F.col("n.opportunity_title")).otherwise(F.col("o.opportunity_title")).alias("opportunity_title"),
        F.coalesce("n.unified_tags", "o.unified_tags").alias("unified_tags"),
        F.coalesce("n.kind", "o.kind").alias("expiry_kind"),
        F.when(fresh & F.col("o").isNotNull(), F.lit("both")).when(fresh, F.lit("new")).otherwise(F.lit("old")).alias("seen_in"),
    )


def replace_bodies(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the bodies that the new rows name give way to the new rows; equality of org_id decides."""
    named = new.where("org_id is not null").select("org_id").distinct()
    return old.join(named, "org_id", "left_anti").select("ord", "org_id").unionByName(new.where("org_id is not null").select("ord", "org_id"))


def new_since(current: DataFrame, baseline: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key the baseline does not have; rows without key count as new."""
    return current.join(baseline.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def pending(bodies: DataFrame, ledger: DataFrame, key: str, ledger_key: str) -> DataFrame:
    """Active bodies (active unless said otherwise) that the ledger does not name."""
    done = ledger.where(F.col(ledger_key).isNotNull()).select(F.col(ledger_key).alias(key)).distinct()
    return bodies.where(F.coalesce("active", F.lit(True))).join(done, key, "left_anti")


def overridden(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Overrides (key, verdict keep or reject) are applied last and always win."""
    return rows.join(overrides.select(key, "verdict"), key, "left").withColumn("qc_status", F.when(F.col("verdict") == "keep", F.lit("passed")).when(F.col("verdict") == "reject", F.lit("rejected")).otherwise(F.col("qc_status"))).drop("verdict")


def appended(existing: DataFrame, entries: DataFrame, key: str, order: str) -> DataFrame:
    """The entries to append: ids neither there already nor earlier among the entries."""
    firsts = entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*entries.columns), order).alias("r")).select("r.*")
    return firsts.join(existing.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def merge_scraped(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """(id, source, status): one source's fresh scrape into all that is known. Rows of that source that it no longer lists become
    inactive; rows of other sources keep their status. A full outer join on the id, a row an id on either side."""
    o = last_written(old.select("ord", "id", "source", "status"), "id", "ord").select("id", F.col("source").alias("old_source"), F.col("status").alias("old_status"))
    n = last_written(new.where(F.col("source") == source).select("ord", "id", "source"), "id", "ord").select("id", F.col("source").alias("new_source"))
    gone = F.col("old_source").eqNullSafe(source)
    status = F.when(F.col("new_source").isNotNull(), F.lit("active")).when(gone, F.lit("inactive")).otherwise(F.col("old_status"))
    return o.join(n, "id", "full_outer").select("id", F.coalesce("new_source", "old_source").alias("source"), status.alias("status"))


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``new``, the last of each key, and those of ``old`` whose key they do not have. Null keys take no part."""
    fresh = last_written(new, key, order)
    return fresh.unionByName(old.where(F.col(key).isNotNull()).join(fresh.select(key), key, "left_anti"))


def of_bodies(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """The rows of the bodies named (id), without inactive ones."""
    return rows.where(~F.col("status").eqNullSafe("inactive")).join(bodies.select(F.col("id").alias("org_id")).distinct(), "org_id", "left_semi")
