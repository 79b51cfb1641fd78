"""The dealt queries: against SQL where there is some, with stable columns and rows everywhere."""

from __future__ import annotations

import os

import pytest

from tallyfold.llm.oracle import ORACLE
from tallyfold.llm.queries import QUERIES

COLUMNS = {
    "p1_found": ["group_ord", "source_ord", "scraped_ord", "schedule_ord"], "p2_found": ["seen_ord", "new_ord"], "p3_found": ["ord_a", "ord_b"], "p4_found": ["name_a", "name_b"],
    "p5_found": ["row_a", "row_b"], "p6_found": ["ord", "gaz_id"], "p9_found": ["doc_id", "start_at", "end_at"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    from conftest import same_rows

    df = QUERIES[name](spark, sf_dir)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    if name in ORACLE:
        same_rows(df, duck, ORACLE[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_over_empty_tables(spark, sf_dir, tmp_path_factory, name):
    """Every table with its schema and no row."""
    folder = tmp_path_factory.mktemp("empty")
    for f in os.listdir(sf_dir):
        spark.read.parquet(f"{sf_dir}/{f}").limit(0).write.parquet(f"{folder}/{f}")
    assert QUERIES[name](spark, str(folder)).count() == 0 or name in ("p8_shares",)
