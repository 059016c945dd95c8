"""Rolling totals over trailing periods by segment trees.

Each entity's weeks are cut into time shards of ``SHARD`` weeks; a shard's segment tree holds sum and count in
``2 * SHARD`` nodes (node 1 the root, nodes SHARD.. the leaves). A trailing span touches whole inner shards by
their roots and the first and last shard by O(log SHARD) nodes each. The trees are a table (entity, shard, node
arrays): a late correction of one week changes one leaf and its ancestors in one row of that table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD = 16
SPANS = (1, 4, 13)
TREES = "entity string, shard bigint, sums array<bigint>, counts array<bigint>"


def week_number(period: Column) -> Column:
    """Weeks since 1970-W01 (which begins on 1969-12-29) of an ISO week; accepts blanks around it, a lower-case w, no
    hyphen and a week of one digit. Null for anything else, and for a week 53 in a year of 52 weeks."""
    p = F.upper(F.trim(period))
    ok = p.rlike(r"\A[0-9]{4}-?W[0-9]{1,2}\z")
    year = F.when(ok, F.substring(p, 1, 4).cast("int"))
    week = F.when(ok, F.regexp_extract(p, r"W([0-9]{1,2})\z", 1).cast("int"))
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_add(F.trunc(jan4, "week"), 7 * (week - 1))
    fits = (week >= 1) & (F.year(F.date_add(monday, 3)) == year)
    return F.when(fits, ((F.datediff(monday, F.lit("1969-12-29").cast("date"))) / 7).cast("bigint"))


def week_name(number: Column) -> Column:
    """The ISO week (YYYY-Www) of a week number."""
    thursday = F.date_add(F.lit("1970-01-01").cast("date"), (number * 7).cast("int"))
    return F.concat(F.lpad(F.year(thursday).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(thursday).cast("string"), 2, "0"))


def latest_statements(df: DataFrame, entity: str = "topic_id", period: str = "period", value: str = "mentions", stated: str = "recorded_at") -> DataFrame:
    """One row per entity and week, by the latest ``stated`` instant; of statements of the same instant the greatest
    value counts, null before any number. A null value states zero. Rows without an entity or a readable week are left out."""
    at = F.to_timestamp(F.col(stated))
    return (
        df.select(F.col(entity).cast("string").alias("entity"), week_number(F.col(period)).alias("week"), at.alias("at"), F.col(value).cast("bigint").alias("value"))
        .where("entity is not null and week is not null")
        .groupBy("entity", "week")
        .agg(F.max(F.struct("at", "value")).alias("last"))
        .select("entity", "week", F.coalesce("last.value", F.lit(0)).alias("value"))
    )


def build_trees(weekly: DataFrame) -> DataFrame:
    """Segment trees (``TREES``) of rows (entity, week, value), one row per entity and shard with any week."""
    leaf = F.struct((F.col("week") % SHARD).cast("int").alias("slot"), "value")
    grouped = weekly.groupBy("entity", F.floor(F.col("week") / SHARD).alias("shard")).agg(F.collect_list(leaf).alias("leaves"))  # at most SHARD leaves

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("leaves")
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            slot, value = np.asarray(flat.field("slot")), np.asarray(flat.field("value"))
            sums, counts = np.zeros((b.num_rows, 2 * SHARD), np.int64), np.zeros((b.num_rows, 2 * SHARD), np.int64)
            sums[owner, SHARD + slot], counts[owner, SHARD + slot] = value, 1
            for node in range(SHARD - 1, 0, -1):
                sums[:, node] = sums[:, 2 * node] + sums[:, 2 * node + 1]
                counts[:, node] = counts[:, 2 * node] + counts[:, 2 * node + 1]
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * 2 * SHARD)
            yield pa.RecordBatch.from_arrays([b.column("entity"), b.column("shard"), *(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (sums, counts))], ["entity", "shard", "sums", "counts"])

    return grouped.mapInArrow(trees, TREES)


def correct(trees: DataFrame, changes: DataFrame) -> DataFrame:
    """``trees`` after late corrections ``changes`` (entity, week, value; each week once, value null: the week is
    withdrawn). Only the changed leaves' ancestors are computed anew; rows of other shards pass through. An entity or
    shard not seen before gets a tree of its own."""
    leaf = F.struct((F.col("week") % SHARD).cast("int").alias("slot"), F.col("value").cast("bigint").alias("value"))
    by_shard = changes.groupBy("entity", F.floor(F.col("week") / SHARD).alias("shard")).agg(F.collect_list(leaf).alias("changes"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, (sums, counts, change) in enumerate(zip(pdf.sums, pdf.counts, pdf.changes)):
                sums = np.zeros(2 * SHARD, np.int64) if sums is None else np.array(sums)
                counts = np.zeros(2 * SHARD, np.int64) if counts is None else np.array(counts)
                for c in change:
                    node = SHARD + c["slot"]
                    sums[node], counts[node] = (0, 0) if c["value"] is None else (c["value"], 1)
                    while node > 1:
                        node //= 2
                        sums[node] = sums[2 * node] + sums[2 * node + 1]
                        counts[node] = counts[2 * node] + counts[2 * node + 1]
                pdf.at[i, "sums"], pdf.at[i, "counts"] = sums, counts
            yield pdf[["entity", "shard", "sums", "counts"]]

    joined = trees.join(by_shard, ["entity", "shard"], "full_outer")
    schema = T._parse_datatype_string(TREES)
    return joined.where("changes is null").select(*schema.names).union(joined.where("changes is not null").mapInPandas(apply, schema))


def _range(tree: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The sum of the leaves lo..hi (empty where lo > hi) of each row's tree, bottom-up over both borders."""
    rows, total = np.arange(len(tree)), np.zeros(len(tree), np.int64)
    lo, hi = lo + SHARD, hi + SHARD + 1
    for _ in range(SHARD.bit_length()):
        open_ = lo < hi
        left, right = open_ & (lo % 2 == 1), open_ & (hi % 2 == 1)
        total += np.where(left, tree[rows, np.where(left, lo, 1)], 0) + np.where(right, tree[rows, np.where(right, hi - 1, 1)], 0)
        lo, hi = (lo + left) // 2, (hi - right) // 2
    return total


def _answer(spans: tuple[int, ...], back: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows

            def tree(name: str, b=b, n=n) -> np.ndarray:
                column = pa.compute.fill_null(b.column(name), [0] * 2 * SHARD)
                return np.asarray(column.flatten()).reshape(n, 2 * SHARD)

            trees = [(tree(f"sums{k}"), tree(f"counts{k}")) for k in range(back + 1)]
            shard, first, last = (np.asarray(b.column(c)) for c in ("shard", "first_week", "last_week"))
            weeks = shard[:, None] * SHARD + np.arange(SHARD)[None, :]
            inside = (weeks >= first[:, None]) & (weeks <= last[:, None])
            row, slot = np.nonzero(inside)
            out = {"entity": b.column("entity").take(pa.array(row)), "week": pa.array(weeks[inside])}
            for span in spans:
                total, stated = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                for k, (sums, counts) in enumerate(trees):
                    lo, hi = slot - span + 1 + k * SHARD, slot + k * SHARD
                    lo, hi = np.clip(lo, 0, SHARD), np.clip(hi, -1, SHARD - 1)
                    total += _range(sums[row], lo, hi)
                    stated += _range(counts[row], lo, hi)
                out[f"total_{span}"], out[f"stated_{span}"] = pa.array(total), pa.array(stated)
            yield pa.RecordBatch.from_arrays([*out.values()], [*out])

    return run


def rolling_totals(weekly: DataFrame, spans: tuple[int, ...] = SPANS, trees: DataFrame | None = None) -> DataFrame:
    """Totals over trailing spans for every entity and every week from its first to the last week of all:
    entity, week, total_N (sum over the N weeks that end there), stated_N (weeks of them with a row).

    ``weekly`` is (entity, week, value) with each week once (see ``latest_statements``). Weeks without a row count as
    zero. The shards of one entity are joined with the at most ceil(max span / SHARD) shards before them, so no task
    holds more of an entity than that. An empty input gives an empty result. ``trees``: those of ``weekly`` where they are
    kept as a table (see ``correct``), so that they aren't built anew.
    """
    back = -(-(max(spans) - 1) // SHARD)
    trees = build_trees(weekly) if trees is None else trees
    bounds = weekly.groupBy("entity").agg(F.min("week").alias("first_week"))
    last = weekly.agg(F.max("week").alias("last_week"))
    grid = bounds.join(F.broadcast(last)).select("entity", "first_week", "last_week", F.explode(F.sequence(F.floor(F.col("first_week") / SHARD), F.floor(F.col("last_week") / SHARD))).alias("shard"))  # one row is broadcast

    # every tree goes to its own shard and the later ones it can reach into
    reach = trees.select("entity", F.explode(F.array(*[F.struct((F.col("shard") + k).alias("shard"), F.lit(k).alias("back")) for k in range(back + 1)])).alias("to"), "sums", "counts")
    near = reach.groupBy("entity", F.col("to.shard").alias("shard")).agg(*[F.max(F.when(F.col("to.back") == k, F.col(c))).alias(f"{c}{k}") for k in range(back + 1) for c in ("sums", "counts")])
    named = [f"{c}{k}" for k in range(back + 1) for c in ("sums", "counts")]
    schema = "entity string, week bigint, " + ", ".join(f"total_{s} bigint, stated_{s} bigint" for s in spans)
    return grid.join(near, ["entity", "shard"], "left").select("entity", "shard", "first_week", "last_week", *named).mapInArrow(_answer(tuple(spans), back), schema)


def _named(rows: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    cols = reduce(lambda a, s: [*a, F.col(f"total_{s}").alias(f"total_{s}w"), F.round(F.col(f"total_{s}") / s, 6).alias(f"avg_{s}w"), F.col(f"stated_{s}").alias(f"stated_{s}w")], spans, [])
    return rows.select(F.col("entity").alias("topic_id"), week_name(F.col("week")).alias("period"), *cols)


def topic_rolling(mentions: DataFrame, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """``rolling_totals`` of topic mentions with names: topic_id, period, total_Nw, avg_Nw (rounded to 6 places; the
    average is over all N weeks of the span) and stated_Nw."""
    return _named(rolling_totals(latest_statements(mentions), spans), spans)


def topic_rolling_corrected(mentions: DataFrame, until: str, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """``topic_rolling`` by late corrections: trees of what had been stated before the instant ``until``, in which what was stated
    later (or at no known time) changes its leaves and their ancestors only."""
    at = F.to_timestamp("recorded_at")
    early, latest = latest_statements(mentions.where(at < F.lit(until).cast("timestamp"))), latest_statements(mentions)
    same = early.select("entity", "week", F.col("value").alias("was"))
    changes = latest.join(same, ["entity", "week"], "left").where(~F.col("value").eqNullSafe(F.col("was"))).drop("was")
    return _named(rolling_totals(latest, spans, correct(build_trees(early), changes)), spans)
