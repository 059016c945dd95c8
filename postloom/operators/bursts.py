"""Greedy bursts: from the first post that is in none yet, all posts within the span; a burst if they are enough, then on
behind it, else on with the next post.

A post can only reach into posts at most one span later, so a group is cut wherever two neighbours lie further apart
than the span: the pieces are independent and lie in different tasks. A piece is carried across batches, so even one
without any gap streams through its task in time order with one burst in memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.relational import before_in_group


def _scan(span: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, piece, window = None, None, []

        def settle(everything: bool, at: int | None = None):
            """Bursts that are complete: nothing later can join them."""
            nonlocal window
            while window and (everything or at - window[0][0] > span):
                n = next((i for i, (t, _) in enumerate(window) if t - window[0][0] > span), len(window))
                if n >= least:
                    yield group, window[0][1], window[0][0], window[n - 1][0], n
                    window = window[n:]
                else:
                    window = window[1:]

        for b in batches:
            out = []
            for g, p, t, r in zip(*(b.column(c).to_pylist() for c in ("grp", "piece", "t", "row_id"))):
                if (g, p) != (group, piece):
                    out += settle(True)
                    group, piece = g, p
                out += settle(False, t)
                window.append((t, r))
            yield _batch(out)
        yield _batch([*settle(True)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["grp", "first_row", "from_s", "to_s", "posts"])


def _pieces(df: DataFrame, group: str, at: str, row_id: str, span_s: int) -> DataFrame:
    """grp, piece, t, row_id, each piece in one task and in time order; neighbours in different pieces lie further apart than the span."""
    stamped = df.select(F.col(group).cast("string").alias("grp"), F.unix_timestamp(at).alias("t"), F.col(row_id).cast("string").alias("row_id")).where("grp is not null and t is not null and row_id is not null")
    ordered = stamped.withColumn("o", F.struct("t", "row_id"))
    gap = before_in_group(ordered, "grp", "o", {}, {"before": F.col("t")})
    cut = F.coalesce(F.col("t") - F.col("before") > span_s, F.lit(False)).cast("int")
    pieces = before_in_group(gap, "grp", "o", {"piece": cut})
    return pieces.select("grp", (F.col("piece") + cut).alias("piece"), "t", "row_id").repartition("grp", "piece").sortWithinPartitions("grp", "piece", "t", "row_id")


def bursts(df: DataFrame, group: str, at: str, row_id: str, span_s: int = 7200, least: int = 4) -> DataFrame:
    """grp, first_row, from_s, to_s (seconds since 1970), posts of every burst of each group. Rows with a null group, time
    or id are left out; posts of one instant are in the order of their ids."""
    return _pieces(df, group, at, row_id, span_s).mapInArrow(_scan(span_s, least), "grp string, first_row string, from_s bigint, to_s bigint, posts bigint")


def _ahead(span: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, window = None, deque()

        def settle(everything: bool, at: int | None = None):
            while window and (everything or at - window[0][0] > span):
                t, n = window[0][0], len(window)  # none of them lies further ahead than the span
                while window and window[0][0] == t:
                    _, g, r = window.popleft()
                    if n >= least:
                        yield g, r, n

        for b in batches:
            out = []
            for g, p, t, r in zip(*(b.column(c).to_pylist() for c in ("grp", "piece", "t", "row_id"))):
                if (g, p) != place:
                    out += settle(True)
                    place = g, p
                out += settle(False, t)
                window.append((t, g, r))
            yield _counted(out)
        yield _counted([*settle(True)])

    return run


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["grp", "row_id", "posts"])


def burst_starts(df: DataFrame, group: str, at: str, row_id: str, span_s: int = 7200, least: int = 4) -> DataFrame:
    """grp, row_id, posts of every row from whose instant on its group has ``least`` posts or more within the span."""
    return _pieces(df, group, at, row_id, span_s).mapInArrow(_ahead(span_s, least), "grp string, row_id string, posts bigint")
