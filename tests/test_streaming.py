import random

from pyspark.sql import functions as F

from sparkloom.streaming import folds, watch


def test_capped_debounce_matches_loop(spark):
    rng = random.Random(5)
    rows = []
    for k in range(20):
        t = 0.0
        for _ in range(rng.randint(1, 40)):
            t += rng.choice([1, 2, 3, 7])
            rows.append((k, t, rng.choice("abc")))
    want = set()
    for k in range(20):
        n, first, last, seen = 0, 0.0, 0.0, set()
        for _, t, p in sorted(r for r in rows if r[0] == k):
            if n and t - last >= 5:
                want.add((k, last + 5, n, ",".join(sorted(seen))))
                n, seen = 0, set()
            first = first if n else t
            n, last = n + 1, t
            seen.add(p)
            if t - first >= 20:
                want.add((k, t, n, ",".join(sorted(seen))))
                n, seen = 0, set()
        if n:
            want.add((k, last + 5, n, ",".join(sorted(seen))))
    df = spark.createDataFrame([*rows, (None, 1.0, "a"), (1, None, "a")], "k int, t double, path string")
    assert set(map(tuple, folds.debounce_capped(df, "k", 5, 4).collect())) == want
    assert folds.debounce_capped(df.limit(0), "k", 5, 4).count() == 0


def test_sliding_log_matches_loop(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 5), i, float(rng.randint(0, 300))) for i in range(300)]
    want = set()
    for k in range(6):
        kept = []
        for _, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            kept = [x for x in kept if x >= t - 60]
            ok = len(kept) < 3
            want.add((k, i, t, ok, 0.0 if ok else max(60 - (t - kept[0]), 1.0)))
            if ok:
                kept.append(t)
    df = spark.createDataFrame(rows, "k int, attempt_id int, t double")
    assert set(map(tuple, folds.sliding_log(df, "k", 3, 60).collect())) == want


def test_coalesce_runs(spark):
    df = spark.createDataFrame([("p", 0.0, False), ("p", 1.0, True), ("p", 2.0, False), ("p", 25.0, False)], "k string, t double, full boolean")
    got = sorted(map(tuple, folds.coalesce_runs(df, "k", 10).collect()))
    assert got == [("p", 0.0, False, 1), ("p", 10.0, True, 2), ("p", 25.0, False, 1)]


def test_actions(spark):
    paths = [".git/HEAD", "a/.gitignore", "node_modules/x.js", "src/a.py", "src/a.py~", "src/.#a", "x/4913", "lib/a.SO", "p.egg-info/x", ".git/config"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(folds.action(F.col("p")).alias("a")).collect()
    assert [r.a for r in got] == ["immediate", "full", "drop", "track", "drop", "drop", "drop", "drop", "drop", "drop"]


def test_progress_round_trip(spark):
    e = spark.createDataFrame([("batch_done", 0, None, "r1"), ("file_done", 3, "/a", "r1")], "event string, chunks int, path string, run_id string")
    lines = watch.to_progress(e)
    assert {r.value for r in lines.collect()} == {'{"event":"batch_done","run_id":"r1"}', '{"event":"file_done","chunks":3,"path":"/a","run_id":"r1"}'}
    assert watch.terminal_of(watch.parse_progress(lines)).first().terminals == 1


def test_stream_debounce(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "2025-01-01 00:00:00", "x"), ("a", "2025-01-01 00:00:03", "y"), ("a", "2025-01-01 01:00:00", "z"), ("a", "2025-01-02 00:00:00", "w")]
    spark.createDataFrame(rows, "k string, ts string, path string").selectExpr("k", "cast(ts as timestamp) ts", "path").write.parquet(src)
    s = spark.readStream.schema("k string, ts timestamp, path string").parquet(src)
    q = watch.session_debounce(s, "k", "ts", "path").writeStream.format("memory").queryName("deb").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.paths for r in spark.table("deb").orderBy("first").collect()] == [["x", "y"], ["z"]]
    c = spark.readStream.schema("k string, ts timestamp, path string").parquet(src).selectExpr("k", "cast(unix_timestamp(ts) as double) t", "path")
    q = watch.capped_debounce(c, "k", 5.0).writeStream.format("memory").queryName("cap").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.paths for r in spark.table("cap").orderBy("flushed_at").collect()][:2] == ["x,y", "z"]
