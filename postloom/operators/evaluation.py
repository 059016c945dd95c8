"""Evaluation analytics over a table of graded results (expected, actual, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Calibration bins (the last includes 1) and thresholds of the sweep.
BINS = ((0.0, 0.6), (0.6, 0.85), (0.85, 1.0))
THRESHOLDS = (0.7, 0.8, 0.9, 0.95)


def confusion(df: DataFrame) -> DataFrame:
    """expected, actual, n of the misses; nulls are compared as values."""
    return df.where(~F.col("expected").eqNullSafe(F.col("actual"))).groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))


def calibration(df: DataFrame) -> DataFrame:
    """Per bin of confidence: rows, mean_confidence and accuracy (null where empty). Confidences outside 0..1 are left out."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, a, b, i == len(BINS) - 1) for i, (a, b) in enumerate(BINS)], "bin int, low double, high double, closed boolean")
    c = F.col("confidence")
    number = F.when(~F.isnan(c) & c.between(0, 1), sum((F.when(c >= a, 1).otherwise(0) for a, _ in BINS[1:]), F.lit(0)))
    graded = df.select(number.cast("int").alias("bin"), c.alias("confidence"), F.col("expected").eqNullSafe(F.col("actual")).cast("int").alias("right")).where("bin is not null")
    sums = graded.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.round(F.avg("right"), 9).alias("accuracy"))
    return bins.join(sums, "bin", "left").select("bin", "low", "high", F.coalesce("rows", F.lit(0)).alias("rows"), "mean_confidence", "accuracy")


def expected_calibration_error(df: DataFrame) -> DataFrame:
    """One row: ece, weighted by rows; null without rows."""
    c = calibration(df)
    return c.agg(F.round(F.sum(F.col("rows") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("rows"), 9).alias("ece"))


def agreement(df: DataFrame, positive: str) -> DataFrame:
    """One row: graded, agreed, false_pass, false_fail, unusable of two judgements (human, judge)."""
    h, j = F.col("human"), F.col("judge")
    usable = h.isNotNull() & j.isNotNull()
    return df.agg(F.count_if(usable).alias("graded"), F.count_if(usable & (h == j)).alias("agreed"), F.count_if(usable & (h != positive) & (j == positive)).alias("false_pass"), F.count_if(usable & (h == positive) & (j != positive)).alias("false_fail"), F.count_if(~usable).alias("unusable"))


def sweep(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Per threshold: would_skip, caught, false_skips of rows (route, confidence, skip_expected). The few thresholds are
    spread over one scan."""
    each = df.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    skip = (F.col("route") == "skip") & ~F.isnan("confidence") & (F.col("confidence") >= F.col("threshold"))
    return each.groupBy("threshold").agg(F.count_if(skip).alias("would_skip"), F.count_if(skip & F.col("skip_expected")).alias("caught"), F.count_if(skip & ~F.col("skip_expected")).alias("false_skips"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change (only before, only after, regression, fix, other change, same) of two runs (key, status)."""
    both = before.select("key", F.col("status").alias("was")).join(after.select("key", F.col("status").alias("now")), "key", "full_outer")
    change = F.when(F.col("now").isNull(), "only before").when(F.col("was").isNull(), "only after").when(F.col("was") == F.col("now"), "same").when(F.col("was") == "passed", "regression").when(F.col("now") == "passed", "fix").otherwise("other change")
    return both.select("key", "was", "now", change.alias("change"))


def field_accuracy(df: DataFrame) -> DataFrame:
    """Per field of ``fields`` (array of struct field, passed): correct, graded; rows with an error are left out."""
    each = df.where("status <> 'errored'").select(F.explode("fields").alias("f"))
    return each.groupBy("f.field").agg(F.count_if("f.passed").alias("correct"), F.count(F.lit(1)).alias("graded"))


def status_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, passed, failed, errored."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "errored")])


def rates(df: DataFrame) -> DataFrame:
    """field, share: the pass rate of all rows and the accuracy of each field of those without an error; null of none."""
    whole = F.struct(F.lit("pass rate").alias("field"), (F.col("status") == "passed").alias("passed"))
    each = df.select("status", F.explode(F.concat(F.array(whole), "fields")).alias("f")).where((F.col("f.field") == "pass rate") | (F.col("status") != "errored"))
    return each.groupBy("f.field").agg((F.count_if("f.passed") / F.count(F.lit(1))).alias("share"))


def compare_rates(before: DataFrame, after: DataFrame) -> DataFrame:
    """field, was, now, delta of the rates of two runs (status, fields); null where a run lacks a field."""
    both = rates(before).withColumnRenamed("share", "was").join(rates(after).withColumnRenamed("share", "now"), "field", "full_outer")
    return both.select("field", F.round("was", 9).alias("was"), F.round("now", 9).alias("now"), F.round(F.col("now") - F.col("was"), 9).alias("delta"))


def triage_audit(df: DataFrame, keys: list[str], agreed: Column, wrong: Column) -> DataFrame:
    """keys, audited_skips, agreed, false_skips, pending, false_skip_rate (null where nothing is decided)."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("audited_skips"), F.count_if(agreed).alias("agreed"), F.count_if(wrong).alias("false_skips"))
    decided = F.col("agreed") + F.col("false_skips")
    return n.select(*keys, "audited_skips", "agreed", "false_skips", (F.col("audited_skips") - decided).alias("pending"), F.round(F.try_divide("false_skips", decided), 9).alias("false_skip_rate"))


def entity_matches(expected: Column, actual: Column) -> Column:
    """Whether a map fits the expected one: null (or only nulls) fits null only; else every expected key, without regard to case
    and surrounding space. Other keys are not graded."""
    found = F.when(F.exists(F.map_values(actual), lambda v: v.isNotNull()), actual)
    plain = lambda c: F.lower(F.trim(c))
    same = F.forall(F.map_keys(expected), lambda k: plain(F.element_at(expected, k)).eqNullSafe(plain(F.element_at(found, k))))
    return F.when(expected.isNull() | found.isNull(), expected.isNull() & found.isNull()).otherwise(same)


def token_totals(spark: SparkSession, df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
