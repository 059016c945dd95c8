"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; partition and row-group pruning is left to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
