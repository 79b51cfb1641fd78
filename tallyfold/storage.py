"""Reading driver tables and keeping intermediate results in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CREATED: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a context, in case they do not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallyfold-package-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "tallyfold.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(home):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder (one parquet file or a folder of them)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests), a local one is made and set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():  # by setCheckpointDir alone
        return set_before.get().rstrip("/")
    own = f"file://{tempfile.mkdtemp(prefix='tallyfold-')}"
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    _CREATED.append((spark, own))
    return own


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; it is removed when the session's process ends."""
    path = f"{shared_dir(spark)}/tallyfold-{label}-{uuid.uuid4().hex[:12]}"
    _CREATED.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut the lineage by a written table: it outlives any executor, unlike a local checkpoint."""
    path = new_folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores before costly work in Python, where the input has fewer splits than there are cores. Large
    inputs have more and are not shuffled; nor is what has been shuffled already (asking for its splits would run it)."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that any shared store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _CREATED:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session has ended already
            pass
