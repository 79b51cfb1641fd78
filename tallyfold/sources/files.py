"""Snapshots, feeds, logs and result files."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.web import plain

T = TypeVar("T")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path or glob, on whatever store it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def json_array(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(stem, ord, raw): the objects of files that each hold one JSON array, in order, every value as text.

    A raw map keeps apart what a typed read would merge: an absent key, null, and an empty object. Missing files
    give nothing; files that do not parse give nothing."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "stem string, ord long, raw map<string,string>")
    whole = spark.read.text(there, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1).alias("stem"), "value")
    parsed = whole.select("stem", F.from_json("value", "array<map<string,string>>").alias("rows"))
    return parsed.select("stem", F.posexplode("rows").alias("ord", "raw")).select("stem", F.col("ord").cast("long").alias("ord"), "raw")


def filled(raw: Column, without: tuple[str, ...] = ("qc",)) -> Column:
    """How many keys of a raw record hold something: not null, not empty text, list or object."""
    return F.size(F.map_filter(raw, lambda k, v: ~k.isin(*without) & v.isNotNull() & ~v.isin("", "[]", "{}")))


def json_lines(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Typed records of JSON-lines files; missing files give nothing, lines that do not parse nulls."""
    there = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of sources whose columns differ; what a source lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def feed(spark: SparkSession, path: str, tag: str = "entry") -> DataFrame:
    """(id, title, author, link, updated, body) of an Atom feed's entries."""
    schema = "id string, title string, author struct<name: string>, link struct<_href: string>, updated string, content string"
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.select(
        F.regexp_replace("id", "^t3_", "").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.regexp_replace("author.name", "^/u/", "").alias("author"),
        F.col("link._href").alias("link"), "updated", F.coalesce(plain(F.col("content")), F.lit("")).alias("body"),
    )


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """(ok, raw_results, gave_up) of a scraper's log: without a log nothing is known and nothing is wrong."""
    if not exists(spark, path):
        return spark.createDataFrame([(True, -1, 0)], "ok boolean, raw_results long, gave_up long")
    return log_health(spark.read.text(path), "value")


def log_health(lines: DataFrame, column: str) -> DataFrame:
    found = F.aggregate(F.regexp_extract_all(column, F.lit(r"->\s*(\d+)\s+raw results"), F.lit(1)), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    gave = F.regexp_count(column, F.lit("Giving up on"))
    got = lines.agg(F.coalesce(F.sum(found), F.lit(0).cast("long")).alias("raw_results"), F.coalesce(F.sum(gave), F.lit(0)).cast("long").alias("gave_up"))
    return got.select((F.col("raw_results") > 0).alias("ok"), "raw_results", "gave_up")


def settings(text: str) -> dict[str, str]:
    """``KEY=value`` lines; comments and blank lines are skipped, quotes around a value taken off."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        if "=" in line and not line.lstrip().startswith("#"):
            k, v = line.split("=", 1)
            out[k.strip()] = v.strip().strip("\"'")
    return out


def replace_table(df: DataFrame, path: str, **options: str) -> None:
    """Write to a fresh folder, move the old one aside, move the fresh one in, then delete the old one: at no time is there
    less than one whole table. A table found aside only, after a crash between the moves, is moved back first."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    fresh, old, aside = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + x) for x in (".next", "", ".last"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(aside) and not fs.exists(old):
        fs.rename(aside, old)
    df.write.mode("overwrite").options(**options).parquet(fresh.toString())
    fs.delete(aside, True)
    if fs.exists(old):
        fs.rename(old, aside)
    if not fs.rename(fresh, old):
        raise OSError(f"{fresh} could not be moved to {path}")
    fs.delete(aside, True)


def retried(step: Callable[[], T], tries: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of a step that may fail for a while; the waits double, the last failure is raised."""
    for n in range(tries):
        try:
            return step()
        except Exception:
            if n + 1 == tries:
                raise
            sleep(wait * 2**n)
    raise ValueError("no tries")


def digest(posts: DataFrame, day: str, most: int = 100) -> str:
    """A Markdown table of new posts (score, subreddit, title, url), the best first; the driver gets ``most`` rows."""
    rows = posts.orderBy(F.desc("score"), F.desc("created"), "title").limit(most).collect()
    lines = [f"## {len(rows)} new posts, {day}", ""]
    if rows:
        lines += ["| Score | Where | Post |", "|:-:|:--|:--|"] + [f"| {r['score']} | {r['subreddit']} | [{(r['title'] or '(untitled)').replace('|', '/').strip()}]({r['url'] or ''}) |" for r in rows]
    else:
        lines.append("_No new posts._")
    return "\n".join(lines) + "\n"


def outputs(**values: object) -> str:
    """``key=value`` lines for a job runner; booleans in lower case."""
    return "".join(f"{k}={str(v).lower() if isinstance(v, bool) else v}\n" for k, v in values.items())
