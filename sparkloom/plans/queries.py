"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ident, scores, text
from ..operators import chunking, evaluation, ingest, intervals, paths, search, settings, symbols
from ..session import table
from ..streaming import folds, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The languages that the vector table's labels stand for here.
LANGS = ("go", "java", "python", "rust", "typescript")


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- inputs -------------------------------------------------------------------------------------------------------------


def vector_docs(spark: SparkSession, d: str) -> DataFrame:
    """The vector table as chunks: five to a file, lines of ten, a language by label."""
    v, i = table(spark, d, "embeddings"), F.col("vec_id")
    start = ((i % 5) * 10 + 1).cast("int")
    lang = F.element_at(F.array(*map(F.lit, LANGS)), (F.col("label") % 5 + 1).cast("int"))
    return v.select(
        i.alias("doc_id"), F.concat(F.lit("/corpus/dir"), F.floor(i / 50), F.lit("/file"), F.floor(i / 5)).alias("file_path"), start.alias("start_line"), (start + 8).cast("int").alias("end_line"),
        lang.alias("language"), F.lit("").alias("symbol_name"), F.lit("block").alias("chunk_type"), "embedding",
    )


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def files(spark: SparkSession, d: str) -> DataFrame:
    """Each file once: a payload sent again repeats all but the time of receipt."""
    return table(spark, d, "file_payloads").select("file_id", "project_path", "path", "content_hash", "language").distinct()


# -- vector search ------------------------------------------------------------------------------------------------------


@query
def cosine_topk(spark, d):
    return search.top_k(vector_docs(spark, d), query_vector(spark, d), 10).select("doc_id", "score")


@query
def cosine_scores(spark, d):
    return search.scored(vector_docs(spark, d), query_vector(spark, d)).select("doc_id", "score")


@query
def cosine_scores_arrow(spark, d):
    return search.scored(vector_docs(spark, d), query_vector(spark, d), arrow=True).select("doc_id", "score")


@query
def batch_topk(spark, d):
    docs = vector_docs(spark, d)
    return search.batch_top_k(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), 10)


@query
def semantic_search_files(spark, d):
    g = search.semantic_search(vector_docs(spark, d), query_vector(spark, d), 10, min_score=0.0)
    return g.select("file_path", "language", "best_score", F.size("matches").alias("n_matches"))


@query
def semantic_search_filtered(spark, d):
    g = search.semantic_search(vector_docs(spark, d), query_vector(spark, d), 10, LANGS, min_score=0.01, paths=["dir1", "dir3", "dir5"], excludes=["file12"])
    return g.select("file_path", "language", "best_score", F.size("matches").alias("n_matches"))


@query
def fanout_2_langs(spark, d):
    return search.fan_out(vector_docs(spark, d), query_vector(spark, d), 20, LANGS[:2]).select("doc_id", "language", "score", "rank")


@query
def postfilter_5_langs(spark, d):
    c = search.fan_out(vector_docs(spark, d), query_vector(spark, d), 10, LANGS)
    return search.passing(c, 0.05, languages=LANGS[:3]).select("doc_id", "language", "score", "rank")


@query
def adaptive_window(spark, d):
    return search.adaptive_window(vector_docs(spark, d), query_vector(spark, d), 30, min_score=0.05).select("doc_id", "file_path", "score", "rank", "window")


# -- hits ---------------------------------------------------------------------------------------------------------------


@query
def dedup_location(spark, d):
    h = table(spark, d, "search_hits").where("file_path is not null and score is not null")
    return search.dedup_by_location(h, ["search_id", "file_path", "start_line", "end_line"], [F.asc("hit_id")]).select("search_id", "file_path", "start_line", "end_line", "score", "hit_id")


@query
def overlap_merge(spark, d):
    h = table(spark, d, "search_hits").where("file_path is not null and score is not null")
    h = search.dedup_by_location(h, ["search_id", "file_path", "start_line", "end_line"], [F.asc("hit_id")]).withColumn("rank", F.col("hit_id"))
    m = search.merge_overlaps(h.select("search_id", "file_path", "start_line", "end_line", "score", "symbol_name", "chunk_type", "language", "rank"), ["search_id", "file_path"])
    return m.select("search_id", "file_path", F.col("rank").alias("hit_id"), "start_line", "end_line", "score", F.size("nested_hits").alias("absorbed"))


@query
def path_filters(spark, d):
    h = table(spark, d, "search_hits").where("file_path is not null")
    return search.passing(h, 0.4, paths=["/src/", "/lib/", "/core/"], excludes=["legacy", "vendor"]).select("hit_id", "file_path", "score")


@query
def hits_by_file(spark, d):
    h = table(spark, d, "search_hits").where("file_path is not null and score is not null")
    return h.groupBy("search_id", "file_path").agg(F.max("score").alias("best_score"), F.count("*").alias("hits"), F.min_by("language", "hit_id").alias("language"))


@query
def p5_found(spark, d):
    """Continuous stretches of lines, and the gaps between them, per search and file."""
    hits = table(spark, d, "search_hits").where(F.col("file_path").isNotNull())
    keys = ["search_id", "file_path"]
    return intervals.cover_and_gaps(intervals.ranges_of_hits(hits, keys), keys).select("search_id", "file_path", "kind", "start_line", "end_line")


# -- symbols, references, files -----------------------------------------------------------------------------------------


@query
def symbol_cascade(spark, d):
    return symbols.search_symbols(table(spark, d, "symbols"), "token", limit=100).select("symbol_id", "name", "kind", "file_path", "line")


@query
def symbol_cascade_prefix(spark, d):
    return symbols.search_symbols(table(spark, d, "symbols"), "Fetch", kinds=["function", "method"], limit=1000).select("symbol_id", "name", "kind", "file_path", "line")


@query
def symbol_definitions(spark, d):
    return symbols.definitions(table(spark, d, "symbols"), "render%", kinds=["method"], limit=1000).select("symbol_id", "name", "kind", "file_path", "line")


@query
def symbols_by_language(spark, d):
    return symbols.names_by_language(table(spark, d, "symbols"))


@query
def latest_symbols(spark, d):
    return symbols.latest_symbols(table(spark, d, "symbols")).select("symbol_id", "file_id", "name", "kind", "line")


@query
def files_like(spark, d):
    return symbols.files_like(table(spark, d, "file_payloads"), "TOKEN", limit=1000)


@query
def reference_counts(spark, d):
    f = table(spark, d, "file_payloads").select("path", "language", "content")  # repeated payloads repeat lines, made distinct below
    per = symbols.extract_references(f).select("name", "file_path", "line").distinct().groupBy("name", "file_path").agg(F.count("*").alias("n"))
    return per.groupBy("name").agg(F.sum("n").alias("lines"), F.count("*").alias("files"))


@query
def reference_search(spark, d):
    f = table(spark, d, "file_payloads").where(F.contains("content", F.lit("logger"))).select("path", "language", "content")
    uses = symbols.extract_references(f).where("name = 'logger'").distinct()
    return symbols.references(uses, "logger", limit=1000).select("file_path", "start_line", "end_line", "chunk_type", "symbol_name", "col")


# -- chunks -------------------------------------------------------------------------------------------------------------


@query
def sliding_window_chunks(spark, d):
    w = chunking.sliding_windows(table(spark, d, "documents"), ["doc_id"], "text")
    return w.select("doc_id", "idx", F.md5("content").alias("content_md5"), "start_line", "end_line")


@query
def gap_fill(spark, d):
    f = table(spark, d, "file_payloads").where("content is not null").select("file_id", F.size(F.split("content", "\n")).alias("lines")).distinct()
    c = table(spark, d, "chunks").where("chunk_type <> 'module'").select("file_id", "start_line", "end_line").distinct()
    return chunking.line_gaps(c, f, ["file_id"])


@query
def oversize_split(spark, d):
    c = table(spark, d, "chunks").where("content is not null").dropDuplicates(["chunk_id"])
    p = chunking.pack_lines(c.select("chunk_id", "content", "start_line", "end_line", "chunk_type", "symbol_name", "signature", "parent_name"))
    return p.select("chunk_id", "piece_no", F.octet_length("content").alias("bytes"), "start_line", "end_line", "chunk_type", "symbol_name")


@query
def structural_chunks(spark, d):
    c = chunking.chunk_files(table(spark, d, "file_payloads").select("file_id", "language", "content"))
    c = c.select("file_id", "language", "idx", "piece_no", "chunk_type", F.octet_length("content").alias("bytes")).distinct()  # repeated payloads
    return c.groupBy("language", "chunk_type").agg(F.count("*").alias("chunks"), F.count_distinct("file_id").alias("files"), F.max("bytes").alias("largest"))


@query
def embedding_texts(spark, d):
    c = table(spark, d, "chunks").where("content is not null")
    rel = text.relative_path(F.col("file_path"), F.col("project_path"))
    return c.select("chunk_id", F.md5(chunking.embedding_text(rel)).alias("with_path"), F.md5(chunking.embedding_text(rel, False)).alias("plain")).distinct()


@query
def token_windows(spark, d):
    ids = F.concat(F.array(F.lit(101)), F.transform(F.split("text", " "), lambda w: F.char_length(w)), F.array(F.lit(102)))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", ids.alias("ids"))
    w = chunking.token_windows(docs, ["doc_id"], "ids", 128, 101, 102)
    return w.select("doc_id", "window_no", F.size("tokens").alias("n"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query
def mean_pool(spark, d):
    m = chunking.mean_pool(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode(F.transform("vector", lambda x: F.round(x, 6))).alias("i", "v"))


# -- keeping current ----------------------------------------------------------------------------------------------------


def _stored(spark, d):
    old = F.when(F.col("file_id") % 7 == 0, F.lit("stale")).otherwise(F.col("content_hash"))
    kept = files(spark, d).where("file_id % 5 <> 0").select("path", old.alias("content_hash"))
    gone = files(spark, d).where("file_id % 11 = 0").select(F.concat("path", F.lit(".gone")).alias("path"), "content_hash")
    return kept.unionByName(gone)


@query
def hash_diff(spark, d):
    return ingest.hash_diff(files(spark, d), _stored(spark, d))


@query
def files_to_send(spark, d):
    return ingest.to_send(files(spark, d), _stored(spark, d)).select("file_id", "path")


@query
def files_to_delete(spark, d):
    return ingest.to_delete(files(spark, d), _stored(spark, d)).select("path")


@query
def upsert_latest(spark, d):
    return ingest.latest_payloads(table(spark, d, "file_payloads")).select("file_id", "received_at", "content_hash", "size")


@query
def indexable_files(spark, d):
    return ingest.indexable(table(spark, d, "file_payloads")).select("file_id", "path").distinct()


@query
def cascade_delete(spark, d):
    gone = table(spark, d, "projects").where("status = 'error' or path_hash < '4'").select(F.col("host_path").alias("project_path"))
    left = ingest.cascade_delete({"symbols": table(spark, d, "symbols"), "chunks": table(spark, d, "chunks")}, gone, "project_path")
    return left["symbols"].groupBy("project_path").agg(F.count("*").alias("rows")).withColumn("source", F.lit("symbols")).unionByName(left["chunks"].groupBy("project_path").agg(F.count("*").alias("rows")).withColumn("source", F.lit("chunks")))


@query
def project_stats(spark, d):
    return ingest.project_stats(table(spark, d, "file_payloads"), table(spark, d, "chunks"), table(spark, d, "symbols"))


@query
def dir_histogram(spark, d):
    return ingest.directory_histogram(files(spark, d))


@query
def dir_histogram_by_project(spark, d):
    return ingest.directory_histogram(files(spark, d), keys=["project_path"])


@query
def project_languages(spark, d):
    return ingest.languages_of(files(spark, d))


@query
def project_summary(spark, d):
    top = ingest.directory_histogram(files(spark, d), keys=["project_path"], n=1).select("project_path", F.col("dir").alias("top_dir"), F.col("file_count").alias("top_files"))
    stats = ingest.project_stats(table(spark, d, "file_payloads"), table(spark, d, "chunks"), table(spark, d, "symbols")).drop("stats")
    return table(spark, d, "projects").select(F.col("host_path").alias("project_path"), "status").join(stats, "project_path", "left").join(top, "project_path", "left").fillna(0, ["total_files", "total_chunks", "total_symbols"])


@query
def file_batches(spark, d):
    b = ingest.batches_of(files(spark, d), ["path"], 20, "project_path")
    return b.groupBy("project_path", "batch_no").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


@query
def latest_run(spark, d):
    return ingest.latest_run(table(spark, d, "events"), "user_id", "ts", ["event_id", "event_type"])


@query
def backfill_hash(spark, d):
    p = table(spark, d, "projects").withColumn("path_hash", F.when(F.col("path_hash") < "8", F.lit("")).otherwise(F.col("path_hash")))
    return ingest.backfill_hash(p).select("host_path", "path_hash")


@query
def identities(spark, d):
    c = table(spark, d, "chunks")
    one = ident.chunk_doc_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.lit(0))
    return c.select("chunk_id", one.alias("doc_id"), ident.collection_name(F.col("project_path")).alias("collection"), ident.path_hash(F.col("project_path")).alias("project_hash"), ident.content_hash(F.col("content")).alias("content_hash")).distinct()


# -- paths, settings, people --------------------------------------------------------------------------------------------


@query
def path_overlap(spark, d):
    dirs = files(spark, d).select(F.regexp_replace("path", r"/[^/]*$", "").alias("path")).distinct()
    return paths.overlapping_roots(table(spark, d, "projects").select(F.col("host_path").alias("path")), dirs)


@query
def longest_prefix_root(spark, d):
    nested = files(spark, d).where("file_id % 3 = 0").select(F.regexp_extract("path", r"^(/[^/]+/[^/]+/[^/]+/[^/]+)/", 1).alias("root")).where("root <> ''")
    roots = table(spark, d, "projects").select(F.col("host_path").alias("root")).unionByName(nested)
    return paths.longest_root(files(spark, d), roots)


@query
def path_languages(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", text.detect_language(p).alias("language"), text.detect_language_client(p).alias("client_language"), text.extension(p).alias("ext"), text.directory_bucket(p).alias("bucket")).distinct()


@query
def watch_actions(spark, d):
    f = files(spark, d).select(text.relative_path(F.col("path"), F.col("project_path")).alias("rel"))
    return f.select("rel", folds.action(F.col("rel")).alias("action")).distinct()


@query
def runtime_config(spark, d):
    s = F.col("s_suppkey")
    db, env = F.when(s % 4 != 0, (s % 3).cast("int")), F.when(s % 5 != 0, (s % 2 * 7).cast("int"))
    value, source = settings.layered(db, env, F.lit(8))
    gpu, gpu_source = settings.layered(db, env, F.lit(-1), zero_is_unset=False)
    return table(spark, d, "supplier").select(s.alias("id"), value.alias("value"), source.alias("source"), gpu.alias("gpu"), gpu_source.alias("gpu_source"), settings.patched(F.lit(5), db).alias("patched"))


@query
def drift_flag(spark, d):
    m = table(spark, d, "projects")
    most = m.agg(F.max("indexed_with_model").alias("current"))
    return m.join(F.broadcast(most)).select("host_path", settings.drift(F.col("indexed_with_model"), F.col("current")).alias("drift"))  # one row is broadcast


@query
def project_settings(spark, d):
    s = settings.project_settings(table(spark, d, "projects"))
    return s.select("host_path", F.size("exclude_patterns").alias("patterns"), "max_file_size")


@query
def owner_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderdate")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    n = settings.counts_per_owner(c, {"open_orders": o.where("o_orderstatus = 'O'"), "all_orders": o}, "c_custkey")
    return n.join(o.groupBy("c_custkey").agg(F.max("o_orderdate").alias("last_order")), "c_custkey", "left")


@query
def valid_keys(spark, d):
    k = table(spark, d, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("key_hash"), F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"))
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.when(F.col("c_acctbal") < 0, F.lit(1)).alias("disabled_at"))
    return settings.valid_keys(k, o).groupBy("owner_id").agg(F.count("*").alias("keys"))


@query
def scalar_functions(spark, d):
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select(
        k.alias("id"), scores.round1(v / 1000).alias("one"), scores.round4(v / 7).alias("four"), scores.percent(k % 7, F.lit(6)).alias("pct"), scores.clamp_limit((k % 1500 - 100).cast("int"), 20).alias("lim"),
        scores.backoff_seconds((k % 9).cast("int")).alias("backoff"), text.human_age(k % 200000).alias("age"),
    )


# -- measuring ----------------------------------------------------------------------------------------------------------


@query
def ema(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    xs = F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda x: x["v"])
    return e.groupBy("event_type").agg(F.round(scores.ema(xs), 6).alias("ema"))


@query
def percentile_nearest(spark, d):
    return evaluation.nearest_rank_percentiles(table(spark, d, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])


def _ranked(spark, d):
    h = table(spark, d, "search_hits").where("file_path is not null and score is not null")
    return h.groupBy("search_id", "file_path").agg(F.max("score").alias("s"), F.count("*").alias("n"))


@query
def rank_agreement(spark, d):
    from pyspark.sql import Window

    r = _ranked(spark, d)
    a = r.withColumn("rank", F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("s"), "file_path")))
    b = r.withColumn("rank", F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("n"), "file_path")))
    pick = lambda x: x.select(F.col("search_id").alias("query"), F.col("file_path").alias("item"), "rank")
    m = evaluation.rank_agreement(pick(a), pick(b))
    return m.select("query", *(F.round(c, 6).alias(c) for c in ("jaccard", "recall", "tau")))


@query
def eval_metrics(spark, d):
    from pyspark.sql import Window

    h = table(spark, d, "search_hits").where("file_path is not null and score is not null")
    rel = text.relative_path(F.col("file_path"), F.col("project_path"))
    h = h.groupBy("search_id", rel.alias("rel_path")).agg(F.max("score").alias("s"))
    r = h.select(F.col("search_id").alias("query"), "rel_path", F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("s"), "rel_path")).alias("rank"))
    cat = F.element_at(F.array(F.lit("concept"), F.lit("path_hint"), F.lit("identifier")), (F.col("query") % 3 + 1).cast("int"))
    q = r.select("query").distinct().select("query", cat.alias("category"), F.lit(5).alias("k"), F.array(F.lit("src/"), F.lit("lib"), F.lit("core/")).alias("expected_paths"), F.array(F.lit("legacy")).alias("anti_paths"))
    m = evaluation.retrieval_metrics(r, q)
    return m.select("category", "queries", *(F.round(c, 6).alias(c) for c in ("hit_rate", "clean_rate", "precision")))


@query
def cosine_parity(spark, d):
    v = table(spark, d, "embeddings")
    p = v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return evaluation.cosine_parity(p).select("pairs", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"))


# -- events -------------------------------------------------------------------------------------------------------------


@query
def debounce(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = folds.debounce(e, "user_id", "ts", "event_type", 6 * 3600)
    return s.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "events", F.array_join("paths", ",").alias("paths"))


def _seconds(spark, d):
    return table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_type").alias("path"), "event_id")


@query
def debounce_capped(spark, d):
    return folds.debounce_capped(_seconds(spark, d), "user_id", 6 * 3600, 4)


@query
def rate_limit(spark, d):
    return folds.sliding_log(_seconds(spark, d).withColumnRenamed("event_id", "attempt_id"), "user_id", 3, 86400)


@query
def run_coalesce(spark, d):
    return folds.coalesce_runs(_seconds(spark, d).select("user_id", "t", (F.col("path") == "purchase").alias("full")), "user_id", 8 * 3600)


@query
def progress_events(spark, d):
    e = table(spark, d, "events").select(
        F.lit("file_done").alias("event"), F.concat(F.lit("/p/"), "event_id").alias("path"), (F.col("event_id") % 5).cast("int").alias("chunks"), F.lit(None).cast("string").alias("message"), F.col("event_type").alias("run_id")
    )
    lines = watch.to_progress(e)
    back = watch.parse_progress(lines)
    return back.groupBy("run_id").agg(F.count("*").alias("events"), F.count("chunks").alias("with_chunks"), F.sum("chunks").alias("chunks"), F.count("message").alias("messages"), F.max("path").alias("last_path"))
