"""Cutting lineage and keeping intermediate tables in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local one is made and set if the master is local (tests);
    a cluster without a shared folder is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """``path`` as a Hadoop path with its scheme, and its file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(place), fs


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place, fs = hadoop_path(spark, path)
    fs.deleteOnExit(place)
    return path


def kept(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for state that outlives the application."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    place, fs = hadoop_path(spark, path)
    fs.delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffled files that nothing refers to any more: it does so when the driver has collected its garbage."""
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: a cut of the lineage that
    outlives the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """``materialize``, and what the one write has counted: ``rows`` and the given aggregates."""
    path, seen = scratch(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def keep_matching(df: DataFrame, ids: DataFrame, on: str, broadcast_rows: int = 1_000_000, rows: int | None = None) -> DataFrame:
    """``df`` restricted to the values of ``on`` in ``ids`` (a materialized frame of one distinct column of keys; ``rows``
    of them, counted here if that isn't given).

    Up to ``broadcast_rows`` keys (some 50 bytes each) are broadcast, so the rest of ``df`` is dropped before any
    shuffle; a larger set goes through an ordinary shuffled semi join. Nulls never match.
    """
    if (ids.count() if rows is None else rows) <= broadcast_rows:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi")
