import json

from postloom.sources import files as S
from postloom.streaming import ingest as I


def test_json_lines_passes_over_broken_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"signal_id": "a"}\n{broken\n\n{"signal_id": "b", "more": 1}\n')
    assert sorted(r.signal_id for r in S.json_lines(spark, str(tmp_path / "e.jsonl"), "signal_id string").where("signal_id is not null").collect()) == ["a", "b"]


def test_append_events_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "signal_id string, n int")
    path = str(tmp_path / "events")
    assert [S.append_events(df, path), S.append_events(df, path)] == [2, 0]
    assert S.append_events(spark.createDataFrame([("c", 3), ("a", 1)], "signal_id string, n int"), path) == 1


def test_run_records(spark, tmp_path):
    for name, body in (("r.json", json.dumps({"started_at": "2026-01-02", "kind": "x"})), ("r-2.json", json.dumps({"started_at": "2026-01-02", "kind": "y"})), ("q.json", json.dumps({"started_at": "2026-01-01", "kind": "z"})), ("bad.json", "{oops")):
        (tmp_path / name).write_text(body)
    good, bad = S.run_records(spark, str(tmp_path), "started_at string, kind string")
    assert [r.kind for r in good.collect()] == ["z", "x", "y"] and bad.count() == 1


def test_store_and_report(spark, tmp_path):
    store = spark.createDataFrame([("SIG-001", "u1", "s")], "id string, source_ref string, summary string")
    rows = spark.createDataFrame([("1", "u1", "s"), ("2", "u2", "s"), ("3", " ", "s"), ("4", None, "s"), ("5", "u2", "s")], "o string, source_ref string, summary string")
    out = S.append_to_store(store, rows, ["source_ref", "summary"], "o", "SIG-", 3)
    assert [(r.o, r.id) for r in out.collect()] == [("2", "SIG-002")]
    S.write_report(out.select("id", "source_ref"), str(tmp_path / "j"), str(tmp_path / "c"))
    assert S.csv_store(spark, str(tmp_path / "c")).columns == ["id", "source_ref"]


def test_stream_once_each(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("k1", "2026-08-10T01:00:00Z"), (" K1 ", "2026-08-10T02:00:00Z"), ("k2", "2026-08-17T00:00:00Z"), (None, "2026-08-17T00:00:00Z"), (None, "2026-08-17T00:00:00Z")]
    (src / "a.json").write_text("\n".join(json.dumps({"source_key": k, "captured_at": t, "source_name": "s"}) for k, t in rows))
    posts = I.deduplicated(I.read_posts(spark, str(src), "source_key string, captured_at string, source_name string"))
    q = posts.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (src / "b.json").write_text(json.dumps({"source_key": "k2", "captured_at": "2026-08-17T05:00:00Z", "source_name": "s"}))
    q.processAllAvailable()
    q.stop()
    once = spark.table("once")
    assert once.count() == 4
    assert sorted(r.posts for r in I.weekly_counts(once, "source_name").collect()) == [1, 3]


def test_stream_attempts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put = lambda n, rows: (src / n).write_text("\n".join(json.dumps(dict(zip(("key", "ok", "counted"), r))) for r in rows))
    put("a.json", [("x", False, True), ("x", False, True), ("y", False, False), ("z", True, True)])
    df = I.attempts(spark.readStream.schema("key string, ok boolean, counted boolean").json(str(src)))
    q = df.writeStream.format("memory").queryName("tries").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    put("b.json", [("x", False, True), ("y", False, True)])
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("tries").collect():
        last[r.key] = max(last.get(r.key, (0, "")), (r.attempts, r.status))
    assert last == {"x": (3, "dead"), "y": (1, "open"), "z": (0, "done")}
