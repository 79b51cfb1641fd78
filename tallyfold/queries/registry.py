"""Where queries and their DuckDB counterparts are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a query under its function's name, with the SQL that computes the same."""

    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return enter


# Pieces of SQL that several counterparts share.
def squeezed(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[\s\x{{00A0}}]+', ' ', 'g'))"


LISTINGS = "volops_dallasdoinggood"
DUP_KEY = f"{squeezed('org_name')}, {squeezed('opportunity_title')}, {squeezed("coalesce(nullif(description_short, ''), nullif(description_long, ''))")}"
SIGNAL = f"coalesce(nullif({squeezed('schedule.date')}, ''), nullif({squeezed('schedule.raw')}, ''))"
FILLED = " + ".join(
    [f"(coalesce({c}, '') <> '')::int" for c in ("id", "source", "source_url", "org_id", "org_name", "org_url", "opportunity_title", "description_short", "description_long", "status", "last_scraped")]
    + [f"(coalesce(len({c}), 0) > 0)::int" for c in ("cause_tags", "unified_tags")]
    + [f"({c} is not null)::int" for c in ("is_virtual", "schedule", "address", "expiry", "geo")]
)
EPOCH = r"""CASE WHEN regexp_matches(trim({x}), '^\d{{1,12}}$') THEN try_cast(trim({x}) AS bigint) * 1000000
 WHEN regexp_matches(trim({x}), '^\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d{{1,6}})?(Z|[+-]\d{{2}}:\d{{2}})?)?$')
 THEN epoch_us(try_cast(regexp_replace(trim({x}), '(:\d{{2}}(\.\d+)?)(Z|[+-]\d{{2}}:\d{{2}})$', '\1') AS timestamp))
  - CASE WHEN regexp_matches(trim({x}), ':\d{{2}}(\.\d+)?[+-]\d{{2}}:\d{{2}}$') THEN (CASE WHEN substr(trim({x}), -6, 1) = '-' THEN -1 ELSE 1 END) * (substr(trim({x}), -5, 2)::bigint * 60 + substr(trim({x}), -2, 2)::bigint) * 60000000 ELSE 0 END END"""
TAXONOMY = "['seniors','children','food_security','education','animals','environment','housing','health','legal','arts','community','crisis_support','foster_care','disabilities','mental_health','immigration','civic','veterans']"


def epoch(x: str) -> str:
    return EPOCH.format(x=x)
