import random

from pyspark.sql import functions as F

from postloom.functions import text as X
from postloom.operators import bursts as B
from postloom.operators import evaluation as E
from postloom.operators import relational as R
from postloom.operators.components import connected_components


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, X.slug, "  --Weird__Slug!! ") == "weird-slug"
    assert one(spark, X.slug, None) == "" == one(spark, X.slug, "!!!")
    assert one(spark, X.scrub, "thanks u/jdoe and /u/jdoe, mail a.b@example.com") == "thanks u/[user] and u/[user], mail [email]"
    assert one(spark, lambda c: X.normalise(F.lit("Dark MODE!!"), c), "see https://x.y/z now") == "dark mode see now"
    got = one(spark, X.summary, "word " * 80)
    assert len(got) == 300 and got.endswith("…")
    assert one(spark, X.escape_tags, "a </post_body> b") == "a &lt;/post_body&gt; b"
    assert one(spark, X.escape_tags, "List<String>") == "List<String>"
    assert [one(spark, X.strict_date, d) for d in ("next spring", "2027-13-01", "20270531", "", "2027-02-28\n")] == [None] * 5
    assert str(one(spark, X.strict_date, "2027-02-28")) == "2027-02-28"
    assert one(spark, X.unfence, "```json\n{\"a\": 1}\n```") == '{"a": 1}'
    assert [one(spark, lambda c: X.iso_week(c.cast("date")), d) for d in ("2026-01-05", "2026-08-15", "2025-12-29")] == ["2026-W02", "2026-W33", "2026-W01"]
    assert one(spark, lambda c: X.detail(F.lit(None).cast("string"), c), "x" * 5000) == "x" * 2000


def test_labels(spark):
    df = spark.createDataFrame([(0.9,), (0.7,), (0.3,), (float("nan"),), (None,), (1.2,)], "x double")
    assert [r[0] for r in df.select(X.label_of(F.col("x"))).collect()] == ["high", "medium", "low", None, None, None]


def test_sample_is_about_a_twentieth(spark):
    n = spark.range(4000).where(X.sample_share(F.concat(F.lit("EV-"), F.col("id").cast("string"))) < 0.05).count()
    assert 120 <= n <= 280


def test_pointers(spark):
    rows = [("a", "b"), ("b", "c"), ("c", None), ("d", None), ("x", "y"), ("y", "x"), ("z", "gone")] + [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", None)]
    got = {r.node: (r.root, r.steps, r.cycle) for r in R.follow_pointers(spark.createDataFrame(rows, "n string, t string"), "n", "t").collect()}
    assert got["a"] == ("c", 2, False) and got["d"] == ("d", 0, False) and got["z"] == ("gone", 1, False)
    assert got["x"] == got["y"] == (None, None, True)
    assert got["n0"] == ("n40", 40, False)


def test_weighted_average_counts_observed_periods(spark):
    rows = [("t", "W30", 10), ("t", "W31", 3), ("t", "W32", 1), ("t", "W33", 3)]
    df = spark.createDataFrame(rows, "k string, p string, v int")
    assert R.trailing_weighted(df, "k", "p", "v", "W33", 8).first().average == (10 + 6 + 3) / 6
    assert R.trailing_weighted(df, "k", "p", "v", "W33", 2).first().average == (3 + 2) / 3


def test_append_new_gives_consecutive_ids(spark):
    store = spark.createDataFrame([("SIG-007", "a")], "id string, k string")
    rows = spark.createDataFrame([("r3", "c"), ("r1", "a"), ("r2", "b"), ("r4", "b")], "o string, k string")
    got = {(r.o, r.id) for r in R.append_new(store, rows, ["k"], "o", "SIG-", 3).collect()}
    assert got == {("r2", "SIG-008"), ("r3", "SIG-009")}


def test_bursts_greedy(spark):
    def run(rows, **kw):
        df = spark.createDataFrame(rows, "g string, at string, id string").withColumn("at", F.to_timestamp("at"))
        return sorted((r.grp, r.first_row, r.posts) for r in B.bursts(df, "g", "at", "id", **kw).collect())

    day = "2026-08-15 "
    rows = [("t", day + t, f"E{i}") for i, t in enumerate(["10:00", "10:30", "11:10", "11:50", "18:00"])]
    assert run(rows) == [("t", "E0", 4)]
    assert run(rows[:3]) == [] == run([])
    assert run([*rows, (None, day + "10:00", "n"), ("t", None, "m")]) == [("t", "E0", 4)]
    rng = random.Random(4)
    many = [(g, f"2026-08-{1 + m // 1440:02d} {m // 60 % 24:02d}:{m % 60:02d}", f"{g}{k:04d}") for g in "ab" for k, m in enumerate(sorted(rng.randrange(20_000) for _ in range(900)))]
    want = []
    for g in "ab":
        own = sorted((t, i) for x, t, i in many if x == g)
        minutes = [int(t[8:10]) * 1440 + int(t[11:13]) * 60 + int(t[14:16]) for t, _ in own]
        k = 0
        while k < len(own):
            j = k
            while j < len(own) and minutes[j] - minutes[k] <= 120:
                j += 1
            if j - k >= 4:
                want.append((g, own[k][1], j - k))
                k = j
            else:
                k += 1
    assert run(many) == sorted(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and {got[i] for i in (200, 201, 202)} == {200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_evaluation(spark):
    rows = [("a", "a", 0.95), ("a", "b", 0.9), ("a", "a", 1.0), ("a", "a", 0.7), ("a", "b", 0.3), ("a", "a", float("nan")), (None, None, None)]
    df = spark.createDataFrame(rows, "expected string, actual string, confidence double")
    cal = E.calibration(df).orderBy("bin").collect()
    assert [r.rows for r in cal] == [1, 1, 3] and abs(cal[2].accuracy - 2 / 3) < 1e-6
    empty = E.calibration(df.limit(0)).orderBy("bin").collect()
    assert [(r.rows, r.accuracy) for r in empty] == [(0, None)] * 3
    assert E.expected_calibration_error(df.limit(0)).first().ece is None
    assert [tuple(r) for r in E.confusion(df).collect()] == [("a", "b", 2)]
    before = spark.createDataFrame([("1", "passed"), ("2", "failed"), ("3", "passed"), ("5", "failed")], "key string, status string")
    after = spark.createDataFrame([("1", "failed"), ("2", "passed"), ("4", "passed"), ("5", "errored")], "key string, status string")
    assert {r.key: r.change for r in E.compare_runs(before, after).collect()} == {"1": "regression", "2": "fix", "3": "only before", "4": "only after", "5": "other change"}
