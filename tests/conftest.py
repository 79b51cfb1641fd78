"""One small session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(v):
    """A value as text that both engines write alike."""
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(canonical(x)) for x in v) + "]"
    return str(v)


def same_rows(df, con, sql) -> None:
    from collections import Counter

    names = sorted(df.columns)
    got = Counter(tuple(canonical(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    there = [x[0] for x in cur.description]
    assert sorted(there) == names
    at = [there.index(c) for c in names]
    want = Counter(tuple(canonical(r[i]) for i in at) for r in cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
