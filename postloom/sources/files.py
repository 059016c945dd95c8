"""File scans and sinks around the tables: tolerant JSON lines, CSV stores, run records, idempotent appends."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.durable import hadoop_path, materialize, measured
from postloom.operators.relational import append_new

#: Folders of the table of written keys.
BUCKETS = 64


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; lines that don't parse are passed over."""
    lines = spark.read.text(path).select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return lines.select("r.*").where("_bad is null").drop("_bad")


def csv_store(spark: SparkSession, path: str) -> DataFrame:
    """A CSV store with a header; missing cells are ''."""
    return spark.read.csv(path, header=True).fillna("")


def run_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Run records (one JSON document a file), oldest first and numbered copies after the original; and the files that
    can't be read."""
    raw = spark.read.option("multiLine", True).schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("file", F.input_file_name())
    copy = F.coalesce(F.regexp_extract("file", r"-(\d+)\.json$", 1).try_cast("int"), F.lit(1))
    raw = materialize(raw.withColumn("copy", copy), "records")  # Spark reads corrupt records only with the whole schema
    return raw.where("_bad is null").orderBy("started_at", "copy").drop("_bad", "copy"), raw.where("_bad is not null").select("file")


def free_path(spark: SparkSession, path: str) -> str:
    """``path``, or with -2, -3 ... before its suffix the first that doesn't exist yet."""
    stem, dot, suffix = path.rpartition(".")
    stem, suffix = (stem, dot + suffix) if dot and "/" not in suffix else (path, "")
    for n in itertools.count(1):
        found = path if n == 1 else f"{stem}-{n}{suffix}"
        place, fs = hadoop_path(spark, found)
        if not fs.exists(place):
            return found


def write_report(df: DataFrame, json_path: str, csv_path: str) -> tuple[str, str]:
    """A report as JSON lines and as CSV with a header, in the frame's column order; nothing is overwritten, a second report gets
    a number. Returns the paths."""
    paths = free_path(df.sparkSession, json_path), free_path(df.sparkSession, csv_path)
    df.write.mode("errorifexists").json(paths[0])
    df.write.mode("errorifexists").csv(paths[1], header=True)
    return paths


def append_events(events: DataFrame, path: str, key: str = "signal_id") -> int:
    """Append envelopes (columns of ``events`` as JSON) whose key hasn't been written yet, and return how many. Run again
    after a crash, it writes nothing twice.

    Written keys are a table of their own beside the events (``path``/_keys, in ``BUCKETS`` folders by hash): of it only the folders
    of the new keys are read. A crash between the two writes leaves events without keys, so the last batch's events
    are looked through as well: each batch is a folder, named by its number. Null keys are not written.
    """
    spark = events.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    _, fs = hadoop_path(spark, path)
    exists = lambda p: fs.exists(hadoop_path(spark, p)[0])
    done = [int(p.getPath().getName().removeprefix("batch=")) for p in fs.listStatus(hadoop_path(spark, path)[0]) if p.getPath().getName().startswith("batch=")] if exists(path) else []
    fresh, seen = measured(events.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_bucket", bucket), "events", buckets=F.collect_set("_bucket"))
    if exists(f"{path}/_keys") and seen["rows"]:
        there = spark.read.schema(f"{key} string, _bucket int").parquet(f"{path}/_keys").where(F.col("_bucket").isin(list(seen["buckets"])))
        fresh = fresh.join(there.select(key), key, "left_anti")
    if done:
        last = json_lines(spark, f"{path}/batch={max(done)}", f"{key} string").select(key)
        missing = last.withColumn("_bucket", bucket)
        if exists(f"{path}/_keys"):
            missing = missing.join(spark.read.schema(f"{key} string, _bucket int").parquet(f"{path}/_keys"), [key, "_bucket"], "left_anti")
        missing.write.mode("append").partitionBy("_bucket").parquet(f"{path}/_keys")
        fresh = fresh.join(last, key, "left_anti")
    fresh, seen = measured(fresh, "events")
    if seen["rows"]:
        fresh.select(F.to_json(F.struct(*events.columns)).alias("value")).write.text(f"{path}/batch={max(done, default=0) + 1}")
        fresh.select(key, "_bucket").write.mode("append").partitionBy("_bucket").parquet(f"{path}/_keys")
    return seen["rows"]


def append_to_store(store: DataFrame, rows: DataFrame, key: list[str], order: str, prefix: str, width: int) -> DataFrame:
    """What a CSV store with ids gains from ``rows``: valid, new by ``key``, numbered on."""
    valid = rows.where(F.forall(F.array(*[F.col(k).isNotNull() & (F.trim(F.col(k)) != "") for k in key]), lambda x: x))
    return append_new(store, valid, key, order, prefix, width)
