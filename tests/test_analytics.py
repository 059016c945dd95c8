import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.functions import replies as P
from postloom.functions import text as X
from postloom.operators import coordination as C
from postloom.operators import durable as D
from postloom.operators import evaluation as E
from postloom.operators import relational as R
from postloom.operators.components import connected_components
from postloom.sources import files as S
from postloom.streaming import ingest as I


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_before_in_group_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), f"{k:05d}", rng.randrange(9)) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o string, v int").withColumn("_part_", F.lit(1)).repartition(7)
    got = R.before_in_group(df, "g", "o", {"total": F.col("v"), "n": F.lit(1)}, {"last": F.col("o")}).collect()
    assert len(got) == len(rows)
    seen = {}
    want = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        total, n, last = seen.get(g, (0, 0, None))
        want[o] = (total, n, last)
        seen[g] = (total + v, n + 1, o)
    assert {r.o: (r.total, r.n, r.last) for r in got} == want
    assert R.before_in_group(df.limit(0), "g", "o", {"n": F.lit(1)}).collect() == []


def test_runs_and_numbers(spark):
    rows = [("x", k, bad) for k, bad in enumerate([True, True, None, True, False, True, True, True])] + [(None, 1, True), (None, 2, True)]
    df = spark.createDataFrame(rows, "g string, o int, bad boolean")
    assert {(r.g, r["first"], r.length) for r in R.runs_of(df, "g", "o", F.col("bad")).collect()} == {("x", 0, 2), ("x", 5, 3), (None, 1, 2)}
    assert [r.number for r in R.number_rows(df.where("g = 'x'"), "o").orderBy("o").collect()] == list(range(1, 9))


def test_attempts_fold(spark):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False), ("b", 2, False), ("b", 3, False), ("b", 4, True), ("c", 1, False)]
    df = spark.createDataFrame(rows, "k string, o int, ok boolean")
    got = {r.k: (r.attempts, r.status) for r in R.fold_attempts(df, "k", "o", F.col("ok"), F.lit(True), 3).collect()}
    assert got == {"a": (1, "done"), "b": (3, "dead"), "c": (1, "open")}


def test_long_chains_and_unfinished_components(spark):
    rows = [(k, k + 1) for k in range(200)] + [(500 + k, 500 + (k + 1) % 7) for k in range(7)]
    got = {r.node: (r.root, r.cycle) for r in R.follow_pointers(spark.createDataFrame(rows, "n bigint, t bigint"), "n", "t").collect()}
    assert got[0] == (200, False) and got[503] == (None, True)
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a bigint, b bigint"), max_rounds=1)


def test_folder_is_required_on_a_cluster(monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Cluster:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Conf)

    with pytest.raises(ValueError):
        D.shared_dir(Cluster)


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail jörg.müller@bücher.example now", "mail [email] now"),
        ("a+b@host-1.v2 and x@y", "[email] and x@y"),
        ("see /u/some_one, r/u/other and éu/nobody", "see u/[user], r/u/other and éu/nobody"),
    ],
)
def test_scrub(spark, text, want):
    assert one(spark, X.scrub, text) == want
    username, email = re.compile(r"(?<![\w/])/?u/[A-Za-z0-9_-]+"), re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
    assert email.sub("[email]", username.sub("u/[user]", text)) == want


def test_summary_scrubs_first(spark):
    assert one(spark, X.summary, "thanks\u00a0\x1c u/jdoe,\n write to a@b.example ") == "thanks u/[user], write to [email]"
    assert one(spark, X.summary, "a@b.example " * 40) == " ".join(["[email]"] * 40)[:299].rstrip() + "…"


def test_add_summary(spark):
    assert tuple(one(spark, X.add_summary, "written: a, b; skipped duplicates: 3; invalid: 0")) == (2, 3, 0)
    assert tuple(one(spark, X.add_summary, "written: none; skipped duplicates: 0; invalid: 1")) == (0, 0, 1)
    assert one(spark, X.add_summary, "failed") is None


def test_json_fingerprint(spark):
    import hashlib

    df = spark.createDataFrame([("t", "Ünï \"q\"", None, ["a", "é"])], "topic_id string, name string, description string, aliases array<string>")
    value = {"topic_id": "t", "name": "Ünï \"q\"", "description": None, "aliases": ["a", "é"]}
    want = hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()[:12]
    assert df.select(X.json_fingerprint(F.struct("*"))).first()[0] == want
    want = hashlib.sha256(json.dumps([*value.values()]).encode()).hexdigest()[:12]
    assert df.select(X.json_fingerprint(F.struct("*"), as_list=True)).first()[0] == want


@pytest.mark.parametrize(
    "reply, status",
    [
        (None, "no text"), ("{oops", "no JSON"), ("[1]", "no object"), ('{"skip": true}', "skip"), ('{"skip": "true"}', "missing confidence, signal_type, summary"), ('{"signal_type": "usability_issue", "summary": "s"}', "missing confidence"),
        ('{"signal_type": "rumour", "summary": "s", "confidence": 0.5}', "bad signal_type"), ('{"signal_type": "usability_issue", "summary": " ", "confidence": 0.5}', "bad summary"),
        ('{"signal_type": "usability_issue", "summary": "s", "confidence": true}', "bad confidence"), ('{"signal_type": "usability_issue", "summary": "s", "confidence": "0.5"}', "bad confidence"),
        ('{"signal_type": "usability_issue", "summary": "s", "confidence": 1.01}', "bad confidence"), ('{"signal_type": "usability_issue", "summary": "s", "confidence": 1, "skip": false}', "ok"),
    ],
)
def test_extraction_reply(spark, reply, status):
    got = one(spark, P.extraction, reply)
    assert got.status == status and (got.summary is None) == (status != "ok")


def test_replies(spark):
    good = one(spark, P.extraction, '{"signal_type": "new_use_case", "summary": "s", "confidence": 0.25, "entity": {"a": 1}, "effective_date": "2027-02-30"}')
    assert (good.confidence, good.entity, good.effective_date) == (0.25, '{"a":1}', None)
    assert tuple(one(spark, P.triage, '{"route": "skip", "confidence": 0.9, "reason": " dull "}')) == ("ok", "skip", 0.9, "dull")
    assert one(spark, P.triage, '{"route": "skip", "confidence": 0.9, "reason": 3}').reason == ""
    assert one(spark, P.triage, '{"route": "maybe", "confidence": 0.9}').status == "bad route"
    items = '[{"title": " A ", "content": "x"}, {"title": " ", "content": "y"}, {"title": "B"}, 7, {"title": "C", "content": ""}, {"title": "D", "content": "z"}]'
    assert [tuple(x) for x in one(spark, lambda c: P.paraphrases(c, 2), items)] == [("A", "x"), ("C", "")]
    assert one(spark, lambda c: P.paraphrases(c, 2), '{"a": 1}') == []


def test_entity_match_and_audit(spark):
    m = lambda x: F.create_map(*[F.lit(v).cast("string") for p in x.items() for v in p]) if x is not None else F.lit(None).cast("map<string,string>")
    cases = [(None, None, True), (None, {"a": None}, True), ({"a": "X"}, None, False), ({"a": " x "}, {"a": "X", "type": "t"}, True), ({"a": "x"}, {"b": "x"}, False), ({"a": None}, {"a": None, "b": "y"}, True)]
    df = spark.range(1)
    assert [df.select(E.entity_matches(m(e), m(a))).first()[0] for e, a, _ in cases] == [w for *_, w in cases]
    rows = spark.createDataFrame([("w", "low"), ("w", "high"), ("w", None), ("v", None)], "week string, outcome string")
    got = {r.week: (r.audited_skips, r.agreed, r.false_skips, r.pending, r.false_skip_rate) for r in E.triage_audit(rows, ["week"], F.col("outcome") == "low", F.col("outcome") == "high").collect()}
    assert got == {"w": (3, 1, 1, 1, 0.5), "v": (1, 0, 0, 1, None)}


def brute_clusters(rows):
    norm = lambda t, c: re.sub(r"[^\w]+", " ", re.sub(r"https?://\S+", " ", f"{t or ''} {c or ''}".lower())).strip()
    parent = {i: i for _, i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (g, i, t, c, _) in enumerate(rows):
        for h, j, u, d, _ in rows[k + 1 :]:
            a, b = norm(t, c), norm(u, d)
            if g == h and (a == b or (a and b and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in parent}


def test_coordination_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"{a}{b}" for a in ("har", "cop", "wal", "tid") for b in ("bour", "per", "nut", "al", "ow")]
    rows = []
    for k in range(70):
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows)[3] or "x").split()
            for _ in range(rng.choice([0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(pool)
        else:
            words = rng.choices(pool, k=rng.choice([3, 12, 30]))
        rows.append((rng.choice("gh"), f"E{k:03d}", rng.choice([None, "", "Title!"]), " ".join(words), f"2026-08-{1 + k // 20:02d} {k % 20:02d}:00"))
    rows += [("g", "E900", None, None, "2026-08-09 10:00"), ("g", "E901", "", "!!", None)]
    df = spark.createDataFrame(rows, "g string, id string, title string, content string, at string").selectExpr("*", "1 as text", "2 as word").withColumn("at", F.to_timestamp("at"))
    got = {r.row_id: r.cluster for r in C.clusters(df, "g", "id", "title", "content").collect()}
    assert got == brute_clusters(rows) and got["E901"] == "E900"
    for r in C.assess(df, "g", "id", "title", "content", "at").collect():
        own = [got[i] for g, i, *_ in rows if g == r.grp]
        assert (r.raw_count, r.distinct_count, r.duplicate_clusters) == (len(own), len(set(own)), sum(own.count(c) > 1 for c in set(own)))
        assert len(r.reasons) == (r.collapsed > 0) + r.bursts
    assert C.assess(df.limit(0), "g", "id", "title", "content", "at").collect() == []


def test_unlike_texts_are_refused_without_the_ratio(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlucm", k=rng.randrange(2, 9))) for _ in range(300)]
    texts = [(f"E{k:03d}", " ".join(rng.choices(words, k=90))) for k in range(150)]
    texts += [("F1", texts[0][1] + " x"), ("F0", texts[0][1][3:])]
    asked, matcher = [], C._matcher
    monkeypatch.setattr(C, "_matcher", lambda a, b: asked.append(a) or matcher(a, b))
    assert {frozenset(x) for x in C.links(texts)} <= {frozenset(x) for x in [("E000", "F0"), ("E000", "F1"), ("F0", "F1")]} and len(asked) == 2
    assert len(list(C.links(texts[:100], texts[100:]))) == 2


def test_alike_texts_with_few_words_in_common(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2)
    text = "measured incremental compaction throughput yesterday evening"
    other = "measurxed incremxental compacxtion throughpxut yestexrday evenixng"
    rows = [("g", "E1", text), ("g", "E2", other), ("g", "E3", "nothing alike"), ("g", "E4", "yet another one"), ("h", "E5", text)]
    df = spark.createDataFrame(rows, "g string, id string, content string").withColumn("title", F.lit(None).cast("string"))
    got = {r.row_id: r.cluster for r in C.clusters(df, "g", "id", "title", "content").collect()}
    assert got == {"E1": "E1", "E2": "E1", "E3": "E3", "E4": "E4", "E5": "E5"}


def test_reports_are_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    paths = [S.write_report(df, str(tmp_path / "r.json"), str(tmp_path / "r.csv")) for _ in range(3)]
    assert [p[0].rsplit("/", 1)[1] for p in paths] == ["r.json", "r-2.json", "r-3.json"]


def test_events_after_a_crash_between_the_writes(spark, tmp_path):
    import shutil

    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "signal_id string, n int")
    path = str(tmp_path / "events")
    assert S.append_events(df, path) == 2
    shutil.rmtree(f"{path}/_keys")
    assert S.append_events(df, path) == 0
    assert S.append_events(spark.createDataFrame([("c", 1), ("a", 2)], "signal_id string, n int"), path) == 1
    assert spark.read.text(f"{path}/batch=*").count() == 3


def test_late_posts_count_in_their_week(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put = lambda n, days: (src / n).write_text("\n".join(json.dumps({"captured_at": f"{x}T00:00:00Z", "source_name": "s"}) for x in days))
    put("a.json", ["2026-08-17", "2027-01-04"])
    counts = I.weekly_counts(I.read_posts(spark, str(src), "captured_at string, source_name string"), "source_name")
    q = counts.writeStream.format("memory").queryName("weeks").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    put("b.json", ["2026-08-19"])
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.week.start)[:10], r.posts) for r in spark.table("weeks").collect()) == [("2026-08-17", 2), ("2027-01-04", 1)]


def test_burst_starts_against_brute_force(spark):
    from postloom.operators import bursts as B

    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(40_000), f"E{k:04d}") for k in range(600)] + [("a", 100, f"P{k}") for k in range(5)] + [(None, 5, "n"), ("a", None, "m")]
    df = spark.createDataFrame(rows, "g string, s bigint, id string").withColumn("at", F.timestamp_seconds("s"))
    for span, least in ((300, 3), (60_000, 4)):
        want = set()
        for g, s, i in rows:
            n = sum(h == g and t is not None and s <= t <= s + span for h, t, _ in rows) if g and s is not None else 0
            if n >= least:
                want.add((g, i, n))
        assert {tuple(r) for r in B.burst_starts(df, "g", "at", "id", span, least).collect()} == want
    assert B.burst_starts(df.limit(0), "g", "at", "id").collect() == []
