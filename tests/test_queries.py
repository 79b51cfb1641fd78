"""Every query of the core against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import same_rows

from tallyfold.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        same_rows(df, duck, ORACLE[name])
    else:
        assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
