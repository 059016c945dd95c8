"""Relational operators the analytics are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.durable import materialize, measured


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order`` (nulls first, so any value is later). An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = [c for c in order] + [c for c in rest if c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*rank)).alias("last")).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits each group before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def in_caller_order(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``wanted`` (``key``, pos and more) asks for, with its columns; missing keys are dropped, repeated
    keys repeated. Sort by pos where the order is needed."""
    return wanted.join(df, key)


def where_given(df: DataFrame, **conditions: tuple[str, object]) -> DataFrame:
    """``df`` under the conditions (column: operator, value) that have a value; one with None is left out."""
    compare = {"=": Column.__eq__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
    for column, (sign, value) in conditions.items():
        if value is not None:
            df = df.where(compare[sign](F.col(column), F.lit(value)))
    return df


def take_until(df: DataFrame, keys: list[str], order: str, stop: DataFrame) -> DataFrame:
    """Of each key the rows after the ``stop`` row (keys, stop_at): what a scan from the newest row takes until it meets the
    cursor. A key without cursor yields all rows."""
    return df.join(stop, keys, "left").where(F.col("stop_at").isNull() | (F.col(order) > F.col("stop_at"))).drop("stop_at")


def as_of(versions: DataFrame, key: str, since: str, version: str, week: str) -> DataFrame:
    """The version of each key in force in ``week``."""
    return latest(versions.where(F.col(since) <= week), [key], version)


def first_of_key(df: DataFrame, key: str, row: str) -> DataFrame:
    """Each row with the first row of its key (``first_row``); rows without a key are their own. Only (key, row) is
    aggregated, so a hot key costs one row a partition before the shuffle."""
    heads = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("first_row"))
    return df.join(heads, key, "left").withColumn("first_row", F.coalesce("first_row", row))


def follow_pointers(df: DataFrame, node: str, to: str) -> DataFrame:
    """node, root, steps, cycle: where chains of pointers end, by pointer doubling (a logarithmic number of joins). A chain
    that runs into a circle has a null root and ``cycle`` true. Unknown targets are roots."""
    # one hop from a root stays there
    start = df.select(F.col(node).alias("node"), F.coalesce(F.col(to), F.col(node)).alias("at"), F.col(to).isNotNull().cast("bigint").alias("steps"))
    cur, seen = measured(start, "pointers")
    ends = df.where(F.col(to).isNotNull()).select(F.col(node).alias("at"), F.lit(True).alias("moves"))
    reach, left = 1, 1
    # a chain visits each node once at most, so what still moves after as many hops as there are nodes runs in a circle
    while left and reach <= seen["rows"]:
        hop = cur.select(F.col("node").alias("at"), F.col("at").alias("then"), F.col("steps").alias("more"))
        nxt = cur.join(hop, "at", "left").select("node", F.coalesce("then", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.coalesce("then", "at") != F.col("at")).alias("moved"))
        cur, more = measured(nxt, "pointers", moved=F.count_if("moved"))
        cur, left, reach = cur.drop("moved"), more["moved"], 2 * reach
    return cur.join(ends, "at", "left").select("node", F.when(F.col("moves").isNull(), F.col("at")).alias("root"), F.when(F.col("moves").isNull(), F.col("steps")).alias("steps"), F.col("moves").isNotNull().alias("cycle"))


def trailing_weighted(df: DataFrame, key: str, period: str, value: str, week: str, observed: int) -> DataFrame:
    """key, average: over the last ``observed`` periods before ``week`` that have a row, weights 1..n from the oldest on."""
    past = df.where(F.col(period) < week)
    w = Window.partitionBy(key).orderBy(F.desc(period))
    ranked = past.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= observed)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    weighted = ranked.withColumn("weight", n - F.col("rn") + 1)
    return weighted.groupBy(key).agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("average"))


def append_new(existing: DataFrame, rows: DataFrame, key: list[str], order: str, prefix: str, width: int) -> DataFrame:
    """The rows of ``rows`` whose key isn't in ``existing`` yet, the first of each key by ``order``, with consecutive ids
    behind the largest of ``existing`` (column ``id``). Ids follow ``order`` over range-partitioned rows: counts per
    partition are added up, no partition holds all rows."""
    fresh = rows.join(existing.select(*key).distinct(), key, "left_anti")
    fresh = top_n(fresh, key, 1, F.col(order)).drop("rank")
    top = existing.agg(F.coalesce(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")), F.lit(0)).alias("top"))
    numbered = number_rows(fresh, order)
    return numbered.join(F.broadcast(top)).withColumn("id", F.concat(F.lit(prefix), F.lpad((F.col("top") + F.col("number")).cast("string"), width, "0"))).drop("top", "number")  # one row


def before_in_group(df: DataFrame, group: str, order: str, sums: dict[str, Column], last: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with, for each row, the sums (and largest values, ``last``) over the rows before it in its group, null groups
    being one group; 0 (null) for the first.

    Rows are placed by ranges of (group, order), so a hot group lies in many tasks. Within a task the values run on
    by a window; what earlier tasks hold of the group is added up per task: only one group reaches from one task into the
    next, so that table has at most one row a task and is broadcast.
    """
    last = last or {}
    placed = df.select("*", *[c.cast("bigint").alias(f"_sum_{k}") for k, c in sums.items()], *[c.alias(f"_last_{k}") for k, c in last.items()])
    placed = materialize(placed.repartitionByRange(F.col(group).asc_nulls_first(), F.col(order)).withColumn("_part", F.spark_partition_id()), "placed")
    whole = [F.sum(f"_sum_{k}").alias(f"_sum_{k}") for k in sums] + [F.max(f"_last_{k}").alias(f"_last_{k}") for k in last]
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(group, "_part").agg(*whole)
    carried = parts.select(F.col(group).alias("_group"), "_part", F.row_number().over(Window.partitionBy(group).orderBy("_part")).alias("_nth"), *[F.sum(f"_sum_{k}").over(earlier).alias(f"_c_{k}") for k in sums], *[F.max(f"_last_{k}").over(earlier).alias(f"_c_{k}") for k in last]).where("_nth > 1").drop("_nth").withColumnRenamed("_part", "_at")
    here = Window.partitionBy("_part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = placed.select("*", *[F.coalesce(F.sum(f"_sum_{k}").over(here), F.lit(0)).alias(f"_h_{k}") for k in sums], *[F.max(f"_last_{k}").over(here).alias(f"_h_{k}") for k in last])
    both = run.join(F.broadcast(carried), (F.col("_part") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")), "left")  # one row a task at most
    return both.select(*df.columns, *[(F.col(f"_h_{k}") + F.coalesce(f"_c_{k}", F.lit(0))).alias(k) for k in sums], *[F.greatest(f"_h_{k}", f"_c_{k}").alias(k) for k in last])


def number_rows(df: DataFrame, order: str, group: str | None = None) -> DataFrame:
    """``number``: 1..n in the order of ``order`` (within ``group``), without a single sorted partition."""
    rows = df if group else df.withColumn("_all", F.lit(0))
    return before_in_group(rows, group or "_all", order, {"number": F.lit(1)}).withColumn("number", F.col("number") + 1).drop("_all")


def versions(df: DataFrame, key: str, order: str, *tracked: str) -> DataFrame:
    """The history of each key as intervals: a row per change of the tracked columns (``valid_from``, ``valid_to`` the ``order``
    of the next change, null for the current one) with its ``version`` from 1 on. Nulls compare as values."""
    w = Window.partitionBy(key).orderBy(order)
    state = F.struct(*tracked)
    changed = df.withColumn("before", F.lag(state).over(w)).withColumn("first", F.row_number().over(w) == 1)
    kept = changed.where(F.col("first") | ~F.col("before").eqNullSafe(state))
    return kept.select(key, *tracked, F.col(order).alias("valid_from"), F.lead(order).over(w).alias("valid_to"), F.row_number().over(w).cast("bigint").alias("version"))


def fold_attempts(df: DataFrame, key: str, order: str, ok: Column, counted: Column, most: int) -> DataFrame:
    """key, attempts, status after all outcomes in order: failures that count until a success (done) or ``most`` of them (dead)."""
    state = df.select(key, order, ok.alias("ok"), (counted & ~ok).cast("bigint").alias("failed"))
    state = before_in_group(state, key, order, {"was_done": F.col("ok").cast("int"), "failed_before": F.col("failed")})
    live = state.where((F.col("was_done") == 0) & (F.col("failed_before") < most))
    out = live.groupBy(key).agg(F.sum("failed").alias("attempts"), F.max("ok").alias("ok"))
    return out.select(key, "attempts", F.when(F.col("ok"), "done").when(F.col("attempts") >= most, "dead").otherwise("open").alias("status"))


def runs_of(df: DataFrame, group: str, order: str, bad: Column, least: int = 2) -> DataFrame:
    """group, first (the ``order`` of its first row) and length of every run of ``least`` or more bad rows in a row."""
    rows = df.select(group, order, F.coalesce(bad, F.lit(False)).alias("bad"))
    marked = before_in_group(rows, group, order, {"island": (~F.col("bad")).cast("int")})  # good rows before: the same all along a run
    return marked.where("bad").groupBy(group, "island").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("island")
