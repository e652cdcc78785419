from pyspark.sql import functions as F

from sparkloom.functions import scores, text
from sparkloom.operators import chunking, settings
from sparkloom.sources import discovery, embedders


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_text(spark):
    lit = F.lit
    assert one(spark, text.first_hop(lit("1.2.3.4, 5.6.7.8"), lit("9.9.9.9:80")), text.first_hop(lit(None).cast("string"), lit("9.9.9.9:80"))) == ("1.2.3.4", "9.9.9.9")
    assert one(spark, text.accepts(lit("text/html, Application/X-NDJSON;q=1"), "application/x-ndjson"), text.accepts(lit("a/b"), "c/d")) == (True, False)
    assert one(spark, text.repository_of_directory(lit("a__b__c")), text.repository_of_directory(lit("x"))) == ("a/b__c", "x")
    assert one(spark, text.query_prefix(lit("x/BGE-base-en")), text.query_prefix(lit("other"))) == ("Represent this sentence for searching relevant passages: ", "")
    assert one(spark, text.signature_of(lit("\tdef f():\r\n  x")), text.signature_of(lit(""))) == ("def f():", "")
    assert one(spark, text.relative_path(lit("/a/b/c"), lit("/a/b/")), text.relative_path(lit("/a/bc"), lit("/a/b"))) == ("c", "/a/bc")
    assert one(spark, text.ancestors(lit("/a/b"))) == (["/a/b", "/a"],)
    assert one(spark, *(text.human_age(lit(n)) for n in (45, 720, 10800, 200000))) == ("45s", "12m", "3.0h", "2.3d")


def test_scores(spark):
    lit = F.lit
    assert one(spark, scores.round1(lit(1.25)), scores.percent(lit(1), lit(0)), scores.percent(lit(1), lit(4)), scores.backoff_seconds(lit(9))) == (1.3, 0.0, 25.0, 60.0)
    assert one(spark, scores.clamp_limit(lit(None).cast("int"), 20), scores.clamp_limit(lit(5000), 20), scores.clamp_limit(lit(-1), 20)) == (20, 1000, 20)
    assert one(spark, scores.retry_hint(lit(None).cast("double"), lit(9.7)), scores.retry_hint(lit(1.0), lit(9.0))) == (9, 5)
    assert one(spark, scores.ema(F.array(lit(3.0), lit(7.0)))) == (4.0,)
    assert one(spark, scores.normalize(F.array(lit(3.0), lit(4.0))), settings.patched(lit(5), lit(0)), settings.patched(lit(5), lit(None).cast("int"))) == ([0.6, 0.8], None, 5)


def test_chunk_helpers(spark):
    files = spark.createDataFrame([("f", "a\nb\n\n\nc", "go")], "file_id string, content string, language string")
    gaps = spark.createDataFrame([("f", 1, 2), ("f", 3, 4)], "file_id string, start_line int, end_line int")
    assert [(r.content, r.start_line) for r in chunking.module_chunks(files, gaps, ["file_id"]).collect()] == [("a\nb", 1)]
    c = spark.createDataFrame([("function", "f", "x"), ("function", None, "y"), ("block", "g", "z")], "chunk_type string, symbol_name string, content string")
    assert [r.symbol_name for r in chunking.symbols_of_chunks(c).collect()] == ["f"]
    r = c.limit(1).withColumn("language", F.lit("go")).select(chunking.embedding_text(F.lit("a/b.go")).alias("t"), chunking.embedding_text(F.lit("")).alias("p")).first()
    assert r.t == "File: a/b.go\nLanguage: go\nfunction: f\n\nx" and r.p == "function: x"


def test_sources(spark, tmp_path):
    assert one(spark, discovery.submodule_paths(F.lit('[submodule "x"]\n\tpath = libs/x\n\turl = y\n'))) == (["libs/x/"],)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "__init__.py").write_text("12345")
    (tmp_path / "b.txt").write_text("123")
    assert discovery.scan(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == 8
    v = embedders.hashing_embedder(8)(["a b", "", "a b"])
    assert v[0] == v[2] and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and not any(v[1])
