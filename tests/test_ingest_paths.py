from sparkloom.functions import ident, text
from sparkloom.operators import evaluation, ingest, paths, settings, symbols
from pyspark.sql import functions as F


def test_hash_diff(spark):
    d = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    s = spark.createDataFrame([("a", "1"), ("b", "x"), ("z", "9")], "path string, content_hash string")
    assert dict(map(tuple, ingest.hash_diff(d, s).collect())) == {"a": "unchanged", "b": "changed", "c": "new", "z": "deleted"}
    assert dict(map(tuple, ingest.hash_diff(d, s, full=True).collect())) == {"a": "changed", "b": "changed", "c": "new"}
    assert {r.path for r in ingest.to_send(d, s).collect()} == {"b", "c"} and {r.path for r in ingest.to_delete(d, s).collect()} == {"z"}
    empty = d.limit(0)
    assert {r.status for r in ingest.hash_diff(d, empty).collect()} == {"new"}


def test_upsert_and_versions(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    n = spark.createDataFrame([(2, "B"), (3, "C"), (3, "C")], "k int, v string")
    u = ingest.upsert(t, n, ["k"])
    assert sorted(map(tuple, u.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    root = str(tmp_path / "t")
    import os

    os.makedirs(root)
    ingest.commit_version(u, root)
    ingest.commit_version(ingest.delete_keys(ingest.read_current(spark, root), n, ["k"]), root)
    assert [tuple(r) for r in ingest.read_current(spark, root).collect()] == [(1, "a")]


def test_buckets_and_languages(spark):
    df = spark.createDataFrame([("/a/b/c/d.go",), ("/a/b/c.go",), ("/a/b.go",), ("/x.R",), ("/p/Makefile",), ("/p/q.tsx",), ("/p/none",), (None,)], "p string")
    got = df.select(text.directory_bucket(F.col("p")).alias("b"), text.detect_language(F.col("p")).alias("l"), text.detect_language_client(F.col("p")).alias("c")).collect()
    assert [r.b for r in got] == ["a/b/c/d.go", "a/b", "a/b.go", None, "p/Makefile", "p/q.tsx", "p/none", None]
    assert [r.l for r in got] == ["go", "go", "go", "r", "make", "tsx", None, None]
    assert got[5].c == "typescript" and got[4].c is None


def test_identity(spark):
    r = spark.range(1).select(ident.path_hash(F.lit("/proj")).alias("h"), ident.chunk_doc_id(F.lit("/p"), F.lit(1), F.lit(2), F.lit(3)).alias("d"), ident.safe_model_name(F.lit("A/b-C")).alias("m")).first()
    assert r.h == "d6f7455193488ce3" and r.d.endswith(":1-2:3") and r.m == "a_b_c"


def test_paths(spark):
    a = spark.createDataFrame([("/repo",), ("/repo-other",), ("/x/",), (None,)], "path string")
    b = spark.createDataFrame([("/repo/server/",), ("/repo",), ("/",), ("/x/y",)], "path string")
    assert sorted(map(tuple, paths.overlapping_roots(a, b).collect())) == [("/repo", "/repo/server"), ("/x", "/x/y")]
    r = spark.createDataFrame([("/r",), ("/r/src",)], "root string")
    p = spark.createDataFrame([("/r/src/a",), ("/r/srcx",), ("/q",), ("/r",)], "path string")
    assert dict(map(tuple, paths.longest_root(p, r).collect())) == {"/r/src/a": "/r/src", "/r/srcx": "/r", "/q": "/q", "/r": "/r"}


def test_symbol_levels(spark):
    rows = [("MyFunc", "function", "a", 1), ("MyClass", "class", "a", 2), ("handler", "function", "b", 3), ("Éa", "function", "b", 4), ("a_b", "function", "b", 5), ("axb", "function", "b", 6)]
    s = spark.createDataFrame([(n, k, f, ln, "/p") for n, k, f, ln in rows], "name string, kind string, file_path string, line int, project_path string")
    names = lambda df: [r.name for r in df.collect()]
    assert names(symbols.search_symbols(s, "myfunc")) == ["MyFunc"]
    assert names(symbols.search_symbols(s, "My")) == ["MyClass", "MyFunc"]
    assert names(symbols.search_symbols(s, "My", kinds=["class"])) == ["MyClass"]
    assert names(symbols.search_symbols(s, "and")) == ["handler"]
    assert names(symbols.search_symbols(s, "éa")) == []
    assert names(symbols.search_symbols(s, "a_b")) == ["a_b", "axb"]
    assert names(symbols.definitions(s, "HANDLER")) == ["handler"]
    assert symbols.search_symbols(s, "zzz").count() == 0 and symbols.search_symbols(s.limit(0), "a").count() == 0


def test_reference_positions(spark):
    f = spark.createDataFrame([("f", "go", "é foo(bar) 3abc foo\nself x\n"), ("g", "go", None)], "path string, language string, content string")
    got = sorted((r.name, r.line, r.col) for r in symbols.extract_references(f).collect())
    assert got == [("bar", 1, 7), ("foo", 1, 3), ("foo", 1, 17)]
    assert symbols.references(symbols.extract_references(f), "foo").count() == 2


def test_settings(spark):
    df = spark.createDataFrame([(0, 5), (None, 0), (3, 1), (None, None)], "db int, env int")
    v, s = settings.layered(F.col("db"), F.col("env"), F.lit(9))
    g, gs = settings.layered(F.col("db"), F.col("env"), F.lit(-1), zero_is_unset=False)
    assert [tuple(r) for r in df.select(v, s, g, gs).collect()] == [(5, "env", 0, "db"), (9, "recommended", 0, "env"), (3, "db", 3, "db"), (9, "recommended", -1, "recommended")]
    p = spark.createDataFrame([("a", "{}"), ("b", "no json"), ("c", '{"exclude_patterns": ["x"], "max_file_size": 7}'), ("d", None)], "host_path string, settings string")
    assert [(r.exclude_patterns, r.max_file_size) for r in settings.project_settings(p).collect()] == [([], 524288), ([], 524288), (["x"], 7), ([], 524288)]


def test_metrics(spark):
    r = spark.createDataFrame([("q", "src/a", 1), ("q", "legacy/b", 2), ("q", "srcx", 3)], "query string, rel_path string, rank int")
    q = spark.createDataFrame([("q", "c", 2, ["src/"], ["legacy"]), ("w", "c", 2, ["src"], ["x"])], "query string, category string, k int, expected_paths array<string>, anti_paths array<string>")
    m = evaluation.retrieval_metrics(r, q).first()
    assert (m.queries, m.hit_rate, m.clean_rate, m.precision) == (2, 50.0, 50.0, 25.0)
    a = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcd")], "query string, item string, rank int")
    b = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("bacx")], "query string, item string, rank int")
    t = evaluation.rank_agreement(a, b, 4).first()
    assert round(t.jaccard, 3) == 0.6 and t.recall == 0.75 and round(t.tau, 4) == 0.3333
