import random

from postloom.operators import rolling as R


def weekly(spark, rows):
    return spark.createDataFrame(rows, "entity string, week bigint, value bigint")


def brute(rows, spans):
    last, out = max(w for _, w, _ in rows), {}
    for e in {r[0] for r in rows}:
        own = {w: v for x, w, v in rows if x == e}
        for w in range(min(own), last + 1):
            out[e, w] = [x for s in spans for x in (sum(own.get(k, 0) for k in range(w - s + 1, w + 1)), sum(k in own for k in range(w - s + 1, w + 1)))]
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(e, w, rng.randrange(50)) for e in "abc" for w in sorted(rng.sample(range(2890, 2990), rng.randrange(1, 60)))]
    for spans in ((1, 4, 13), (2, 40)):
        got = {(r[0], r[1]): [*r[2:]] for r in R.rolling_totals(weekly(spark, rows), spans).collect()}
        assert got == brute(rows, spans)


def test_empty(spark):
    assert R.rolling_totals(weekly(spark, [])).collect() == []


def test_week_forms(spark):
    df = spark.createDataFrame([("2026-W01",), ("2026w1",), (" 2026-W01 ",), ("2026-W53",), ("2025-W53",), ("2026-W00",), ("x",), (None,)], "p string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(R.week_name(R.week_number(F.col("p")))).collect()]
    assert got == ["2026-W01"] * 3 + ["2026-W53", None, None, None, None]


def test_latest_statement_ties_and_nulls(spark):
    rows = [("t", "2026-W02", 5, "2026-01-10T00:00:00+00:00"), ("t", "2026W2", 9, "2026-01-11T00:00:00+00:00"), ("t", "2026-W02", 7, "2026-01-11T00:00:00Z"), ("t", "2026-W03", None, "2026-01-18T00:00:00Z"), (None, "2026-W03", 1, None), ("u", "2026-W03", 4, None)]
    df = spark.createDataFrame(rows, "topic_id string, period string, mentions int, recorded_at string").selectExpr("*", "'clash' as entity", "1 as week")
    got = {(r.entity, r.week): r.value for r in R.latest_statements(df).collect()}
    assert sorted(got.values()) == [0, 4, 9]


def test_correction_changes_only_ancestors(spark):
    rows = [("a", 2900 + k, k) for k in range(40)] + [("b", 2905, 3)]
    trees = R.build_trees(weekly(spark, rows))
    changes = weekly(spark, [("a", 2910, 100), ("a", 2911, None), ("c", 2950, 8)])
    fixed = [r for r in rows if r[:2] not in {("a", 2910), ("a", 2911)}] + [("a", 2910, 100), ("c", 2950, 8)]
    key = lambda r: (r.entity, r.shard)
    assert sorted(R.correct(trees, changes).collect(), key=key) == sorted(R.build_trees(weekly(spark, fixed)).collect(), key=key)
