"""Structured Streaming: exactly-once ingest, weekly counts, idempotent event sink, retry state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postloom.operators.quotient import identifier
from postloom.sources.files import append_events


def read_posts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Posts as they land (JSON files); the stream's checkpoint is the cursor."""
    return spark.readStream.schema(schema).json(path)


def deduplicated(posts: DataFrame, key: str = "source_key", at: str = "captured_at", late: str = "30 days") -> DataFrame:
    """Posts with an identifier, one each, and all posts without one; the latter are split off first, so they need no state.

    State holds each identifier for ``late`` after its row's time: a post sent again later than that passes, and a first post
    that is older than the watermark is dropped; ``exactly_once`` over the stored table settles both.
    """
    stamped = posts.withColumn("at", F.to_timestamp(at)).withColumn("identifier", identifier(key))
    known = stamped.where("identifier is not null").withWatermark("at", late).dropDuplicatesWithinWatermark(["identifier"])
    return known.drop("identifier").union(stamped.where("identifier is null").drop("identifier"))


def weekly_counts(posts: DataFrame, by: str, at: str = "captured_at") -> DataFrame:
    """Posts per calendar week (from Monday) and ``by``, for output in update or complete mode. Without a watermark: a post
    counts in its week however late it comes; state is one number per week and value of ``by``."""
    return posts.withColumn("_at", F.to_timestamp(at)).groupBy(F.window("_at", "7 days", "7 days", "4 days").alias("week"), by).agg(F.count(F.lit(1)).alias("posts"))


def burst_starts(posts: DataFrame, by: str, at: str = "captured_at", span: str = "2 hours", slide: str = "30 minutes", least: int = 4) -> DataFrame:
    """Windows of ``span`` (one every ``slide``) in which ``by`` has ``least`` posts or more, while they come in."""
    counts = posts.withColumn("_at", F.to_timestamp(at)).groupBy(F.window("_at", span, slide).alias("window"), by).agg(F.count(F.lit(1)).alias("posts"))
    return counts.where(F.col("posts") >= least)


def start_event_sink(signals: DataFrame, path: str, checkpoint: str):
    """Emit each signal once; a batch that is run again finds its events written."""
    return signals.writeStream.foreachBatch(lambda df, _: append_events(df, path) and None).option("checkpointLocation", checkpoint).start()


def attempts(outcomes: DataFrame, most: int = 3) -> DataFrame:
    """key, attempts, status (open, done, dead) after each batch of outcomes (key, ok, counted): failures that count add up
    across batches until ``most``; a success ends it. State is one small row per key."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, status = state.get if state.exists else (0, "open")
        for pdf in parts:
            for ok, counted in zip(pdf.ok, pdf.counted):
                if status == "open":
                    n += int(bool(counted) and not ok)
                    status = "done" if ok else "dead" if n >= most else "open"
        state.update((n, status))
        yield pd.DataFrame({"key": [key[0]], "attempts": [n], "status": [status]})

    return outcomes.groupBy("key").applyInPandasWithState(step, "key string, attempts int, status string", "attempts int, status string", "update", GroupStateTimeout.NoTimeout)
