import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom import session
from sparkloom.operators import access, chunking, ingest, paths, prefix, runs, search
from sparkloom.sources import embedders
from sparkloom.streaming import folds, watch


def test_numbers_and_segments_of_a_hot_key(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randint(0, 400), i) for i in range(600)] + [(None, 5, 600), (None, 50, 601)]
    df = spark.createDataFrame(rows, "k string, t int, i int").repartition(5)
    groups = defaultdict(list)
    for k, t, i in rows:
        groups[k].append((t, i))
    want = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g))}
    assert {r.i: r.n for r in prefix.numbered(df, ["k"], ["t", "i"], "n").collect()} == want
    want = {}
    for g in groups.values():
        n, last = 0, None
        for t, i in sorted(g):
            n += last is None or t - last >= 4
            want[i], last = n, t
    got = {r.i: r.s for r in prefix.segmented(df, ["k"], "t", 4, "s").collect()}
    assert got == want
    assert prefix.segmented(df.limit(0), ["k"], "t", 4, "s").count() == 0


def test_batches(spark):
    df = spark.createDataFrame([("p", f"{i:03d}") for i in range(12)], "k string, f string")
    assert [r.batch_no for r in ingest.batches_of(df, ["f"], 0, "k").orderBy("f").collect()] == [i // 5 for i in range(12)]
    assert [r.batch_no for r in ingest.batches_of(df, ["f"], 7, "k").orderBy("f").collect()] == [i // 7 for i in range(12)]
    assert {r.batch_no for r in ingest.batches_of(df, ["f"], 999, "k").collect()} == {0}


def test_versions_are_switched_and_dropped(spark, tmp_path):
    root = str(tmp_path / "t")
    a = ingest.commit_version(spark.range(3), root)
    b = ingest.commit_version(ingest.read_current(spark, root).where("id > 0"), root)
    assert a != b and ingest.current_version(spark, root) == b and ingest.read_current(spark, root).count() == 2
    assert ingest.drop_versions(spark, root) == 1 and ingest.read_current(spark, root).count() == 2


def test_tables_are_released(spark):
    t = session.materialize(spark.range(5))
    assert t.count() == 5
    path = t.inputFiles()[0]
    session.release(spark)
    assert not session.file_system(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_sessions(spark):
    s = spark.createDataFrame([(1, 1, 0, 10, 0), (2, 1, 0, 5, 0), (3, 9, 0, None, 0), (4, 2, 0, 10, 0)], "session_id int, user_id int, c int, e int, l int")
    at = lambda c: F.timestamp_seconds(c)
    s = s.select("session_id", "user_id", at("c").alias("created_at"), at("e").alias("expires_at"), at("l").alias("last_seen_at"))
    u = spark.createDataFrame([(1, "admin", None), (2, "admin", 1)], "user_id int, role string, d int").select("user_id", "role", at("d").alias("disabled_at"))
    now = at(F.lit(5))
    assert {r.session_id: r.status for r in access.session_status(s, u, now).collect()} == {1: "valid", 2: "expired", 3: "unknown", 4: "disabled"}
    assert {r.session_id for r in access.expired(s, now).collect()} == {2, 3} and {r.session_id for r in access.others(s, 1, 1).collect()} == {2}
    used = access.touched(s, spark.createDataFrame([(1, 4), (1, 3), (2, 7), (8, 1)], "session_id int, t int").select("session_id", at("t").alias("at")))
    assert {r.session_id: (r.l, r.e) for r in used.select("session_id", F.unix_seconds("last_seen_at").alias("l"), F.unix_seconds("expires_at").alias("e")).collect()} == {1: (4, 4 + 14 * 86400), 2: (0, 5), 3: (0, None), 4: (0, 10)}
    assert {r.user_id: r.removable for r in access.removable(u).collect()} == {1: False, 2: True}


def test_active_run_blocks_another(spark):
    r = spark.createDataFrame([("a", "p", "running", None)], "run_id string, project_path string, status string, started_at timestamp")
    with pytest.raises(ValueError):
        runs.begin({}, r, "p", "b", F.current_timestamp())
    assert [x.status for x in runs.ended(r, r, "cancelled").collect()] == ["cancelled"]


def test_login_limits_match_loop(spark):
    rng = random.Random(12)
    rows = [(i, f"ip{rng.randint(0, 1)}", rng.choice([" A@x", "a@X ", "b@x", None]), float(rng.randint(0, 900)), rng.random() < 0.2) for i in range(300)]
    ips, pairs, want = defaultdict(list), defaultdict(list), set()
    for i, ip, mail, t, ok in sorted(rows, key=lambda r: (r[3], r[0])):
        key = (ip, (mail or "").strip().lower())
        for log, w in ((ips[ip], 30), (pairs[key], 100)):
            log[:] = [x for x in log if x >= t - w]
        wait = max(30 - (t - ips[ip][0]), 1.0) if len(ips[ip]) >= 4 else max(100 - (t - pairs[key][0]), 1.0) if len(pairs[key]) >= 3 else None
        want.add((ip, i, t, wait is None, wait or 0.0))
        if wait is None:
            ips[ip].append(t)
            pairs[key].append(t)
            if ok:
                pairs[key].clear()
    df = spark.createDataFrame(rows, "attempt_id int, address string, email string, t double, success boolean")
    assert set(map(tuple, folds.login_limits(df, (3, 100.0), (4, 30.0)).collect())) == want


def test_restart_budget(spark):
    df = spark.createDataFrame([("s", i, float(t)) for i, t in enumerate([0, 10, 400, 410, 420, 430, 9000])], "k string, failure_id int, t double")
    got = [(r.attempt, r.backoff, r.dead) for r in folds.restart_budget(df, "k").orderBy("t").collect()]
    assert got == [(1, 1.0, False), (2, 2.0, False), (1, 1.0, False), (2, 2.0, False), (3, 4.0, False), (4, None, True), (None, None, True)]


def test_triggers_clear_what_is_pending(spark):
    df = spark.createDataFrame([("k", 0.0, "a", "track"), ("k", 2.0, ".git/HEAD", "immediate"), ("k", 3.0, "b", "track"), ("k", 3.5, "x", "drop"), ("k", 20.0, "c", "track"), ("k", 30.0, ".gitignore", "full")], "k string, t double, path string, action string")
    got = sorted(map(tuple, folds.debounce_routed(df, "k", 5).collect()), key=lambda r: r[1])
    assert got == [("k", 2.0, "immediate", 1, ".git/HEAD"), ("k", 8.0, "incremental", 1, "b"), ("k", 25.0, "incremental", 1, "c"), ("k", 30.0, "full", 1, ".gitignore")]


def test_embedding_answers():
    assert embedders.in_order([{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}], 2) == [[1], [2]]
    for bad in ([{"index": 0, "embedding": [1]}], [{"index": 0, "embedding": [1]}] * 2, [{"index": 2, "embedding": [1]}]):
        with pytest.raises(ValueError):
            embedders.in_order(bad, 2)


def test_collections(spark, tmp_path):
    df = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3), (None, 4)], "project_path string, v int")
    embedders.write_collections(df, str(tmp_path / "c"))
    assert {r.v for r in embedders.collection(spark, str(tmp_path / "c"), "p").collect()} == {1, 2}
    assert {r.v for r in embedders.drop_collection(df, "p").collect()} == {3, 4}


def test_wire_payloads(spark):
    body = lambda n: '{"files": [' + ", ".join(['{"path": "a"}'] * n) + "]}"
    df = spark.createDataFrame([(0, body(50)), (1, body(51)), (2, "{"), (3, None), (4, body(0))], "request_id int, value string")
    assert {r.request_id: r.error for r in embedders.wire_payloads(df).collect()} == {0: None, 1: "too many files", 2: "invalid", 3: "invalid", 4: "empty"}


def test_allow_list():
    kept, unknown = chunking.enabled_languages([" Go", "python", "klingon", ""])
    assert sorted(kept) == ["go", "python"] and unknown == ["klingon"] and chunking.enabled_languages([])[1] == []


def test_creatable(spark):
    p = spark.createDataFrame([("/a/b/",)], "path string")
    c = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",), ("/a/bc",), (None,)], "path string")
    assert dict(map(tuple, paths.creatable(p, c).collect())) == {"/a": "overlaps", "/a/b": "exists", "/a/b/c": "overlaps", "/a/bc": "new"}


def test_reversed_bounds_merge_as_in_a_plain_fold(spark):
    rng = random.Random(21)
    rows = [(i, "f", rng.randint(1, 30), rng.randint(1, 30), rng.choice(["", "s"]), round(rng.random(), 3)) for i in range(120)]
    want, seen = [], set()
    for r in sorted(rows, key=lambda r: (r[2] - r[3], r[2], -r[5], r[0])):
        for p in want:
            c = p["s"] <= r[2] and p["e"] >= r[3] and (p["s"], p["e"]) != (r[2], r[3])
            if c or ((p["n"] or r[4]) and (p["e"] + 1 == r[2] or r[3] + 1 == p["s"])):
                p["k"] += 1
                p["b"] = max(p["b"], r[5])
                break
        else:
            want.append({"i": r[0], "s": r[2], "e": r[3], "n": r[4], "b": r[5], "k": 0})
    df = spark.createDataFrame([(*r, "block") for r in rows], "rank int, file_path string, start_line int, end_line int, symbol_name string, score double, chunk_type string")
    got = {(r["rank"], r.score, len(r.nested_hits)) for r in search.merge_overlaps(df).collect()}
    assert got == {(p["i"], p["b"], p["k"]) for p in want}


def test_batch_top_k_with_many_ties(spark):
    v = [(999 - i, [1.0, 0.0]) for i in range(1000)] + [(5000, [0.0, 0.0]), (5001, None), (5002, [1.0, 0.0, 0.0])]
    docs = spark.createDataFrame(v, "doc_id bigint, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id bigint, embedding array<float>")
    got = search.batch_top_k(docs, q, 10)
    assert [r.doc_id for r in got.where("query_id = 1").orderBy("rank").collect()] == list(range(10)) and got.where("query_id <> 1").count() == 0
    assert search.batch_top_k(docs.limit(0), q, 10).count() == 0 and search.batch_top_k(docs, q.limit(0), 10).count() == 0


def test_progress_stream_round_trip(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([('{"event":"file_done","chunks":2,"run_id":"r"}',), ('{"event":"batch_done","run_id":"r"}',), ("no json",), ('{"event":"error","message":"' + "x" * (1 << 20) + '"}',)], "value string").write.text(src)
    q = watch.progress_sink(watch.progress_source(spark, src).where("event is not null"), out, str(tmp_path / "ck"))
    q.awaitTermination(120)
    back = watch.parse_progress(spark.read.text(out))
    assert sorted((r.event, r.chunks) for r in back.collect()) == [("batch_done", None), ("file_done", 2)]
    assert watch.outcome_of(back).first().outcome == "done"
