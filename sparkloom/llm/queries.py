"""Registered queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, table
from . import credentials, docpairs, handwritten, mixing, spans, splitting, syntax, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _records(spark: SparkSession, d: str) -> DataFrame:
    """(record_kind, record_id, content) of files and chunks."""
    files = table(spark, d, "file_payloads").select(F.lit("file").alias("record_kind"), F.col("file_id").alias("record_id"), "content")
    chunks = table(spark, d, "chunks").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), "content")
    return files.unionByName(chunks)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of files and chunks on which a credential's value begins."""
    return credentials.credential_lines(_records(spark, d), ["record_kind", "record_id"], "content").distinct()


@query
def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Digest and size of each record's redacted content, and whether it changed."""
    r = credentials.redact_column(_records(spark, d).withColumn("before", F.sha2("content", 256)), "content")
    after = F.sha2("content", 256)
    return r.select("record_kind", "record_id", after.alias("redacted_hash"), F.octet_length("content").alias("redacted_bytes"), (after != F.col("before")).alias("changed")).distinct()


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose content is no valid source of their language."""
    return syntax.parse_flags(table(spark, d, "file_payloads")).where("not valid").select("file_id").distinct()


@query
def p2_errors(spark: SparkSession, d: str) -> DataFrame:
    """The place of the first error of each invalid file."""
    return syntax.parse_flags(table(spark, d, "file_payloads"), errors=True).where("not valid").distinct()


@query
def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of invalid files per project and language."""
    return syntax.invalid_rates(syntax.parse_flags(table(spark, d, "file_payloads")))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods whose file documents them itself: those whose text comes from no class above."""
    got = docpairs.documented(table(spark, d, "symbols"), table(spark, d, "file_payloads"), code=False)
    return got.where("level = 0").select("file_id", "line").distinct()


@query
def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and documentation of each function and method, inherited documentation resolved."""
    got = docpairs.documented(table(spark, d, "symbols"), table(spark, d, "file_payloads"))
    return got.select("file_id", "line", "name", "kind", "parent_name", "documented_in", "level", "signature", "code", "documentation")


@query
def p3_inherited(spark: SparkSession, d: str) -> DataFrame:
    """How many documented declarations have their text from how many steps up the hierarchy, per language."""
    got = docpairs.documented(table(spark, d, "symbols"), table(spark, d, "file_payloads"), code=False)
    return got.groupBy("language", "level").agg(F.count("*").alias("declarations"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Files nobody wrote by hand for their project."""
    return handwritten.not_handwritten(table(spark, d, "file_payloads")).select("file_id")


@query
def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many files each reason accounts for."""
    return handwritten.not_handwritten(table(spark, d, "file_payloads")).groupBy("reason").agg(F.count("*").alias("files"))


@query
def p4_handwritten(spark: SparkSession, d: str) -> DataFrame:
    """The files that remain, with the number of bytes of their content."""
    files = table(spark, d, "file_payloads").where(F.col("content").isNotNull() & F.col("content").rlike(r"\S"))
    out = handwritten.not_handwritten(files)
    return files.select("file_id", "project_path", "path", F.octet_length("content").alias("bytes")).distinct().join(out, "file_id", "left_anti")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over the limit, and whether they can be cut at line ends alone."""
    out = splitting.split_oversized(table(spark, d, "chunks"), "chunk_id", "content", "start_line", once=False)
    return out.select("chunk_id", "cut_kind").distinct()


ORACLE["p6_found"] = """
SELECT DISTINCT chunk_id, CASE WHEN max(octet_length(encode(line)) + CASE WHEN i < n THEN 1 ELSE 0 END) <= 4500 THEN 'line' ELSE 'inside' END AS cut_kind
FROM (SELECT chunk_id, len(ls) AS n, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
      FROM (SELECT DISTINCT chunk_id, content, string_split(content, chr(10)) AS ls FROM chunks WHERE octet_length(encode(content)) > 4500))
GROUP BY chunk_id
"""


@query
def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all chunks over the limit."""
    return splitting.split_oversized(table(spark, d, "chunks"), "chunk_id", "content", "start_line")


@query
def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each chunk over the limit say together: the text without the repeated bytes, the lines from the
    first piece to the last, whether all fit and none repeats more than it may."""
    chunks = table(spark, d, "chunks").where("content is not null").dropDuplicates(["chunk_id"])
    p = splitting.split_oversized(chunks, "chunk_id", "content", "start_line")
    fresh = F.expr("substring(encode(content, 'utf-8'), overlap_bytes + 1)")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", F.hex(fresh).alias("h")))), lambda x: x["h"]), "")  # one chunk's own bytes
    fits = F.max(F.octet_length("content")) <= splitting.LIMIT
    repeats = (F.max("overlap_bytes") <= splitting.OVERLAP) & (F.max(F.when(F.col("piece_no") > 0, F.col("overlap_bytes"))) >= 0)
    return p.groupBy("chunk_id").agg(F.md5(F.unhex(text)).alias("content_md5"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), fits.alias("fits"), repeats.alias("repeats"), (F.count("*") > 1).alias("several"))


ORACLE["p6_round_trip"] = """
SELECT DISTINCT chunk_id, md5(content) AS content_md5, start_line AS first_line, (start_line + length(content) - length(replace(content, chr(10), '')) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END)::INTEGER AS last_line, true AS fits, true AS repeats, true AS several
FROM chunks WHERE octet_length(encode(content)) > 4500
"""


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, d, "documents"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens), written once: the mixture reads the sizes several times."""
    checkpoint_dir(spark)
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return tokens.token_counts(docs).select("doc_id", "source", "n_tokens").checkpoint()


def _mixture(spark: SparkSession, d: str, total: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, goals, mixture)"""
    docs, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    goals = mixing.plan(docs, targets, total=total).checkpoint()
    return docs, goals, mixing.mix(docs, targets, goals=goals)


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of tokens that the sources reach in a mixture of the corpus's own size: small sources are clamped at their
    most repeats, and the others take over what they lack."""
    docs, goals, mixed = _mixture(spark, d, mixing.CORPUS)
    return mixing.report(mixed, docs, goals)


@query
def p8_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same of the largest mixture in which every source keeps its target share."""
    docs, goals, mixed = _mixture(spark, d, None)
    return mixing.report(mixed, docs, goals)


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Each used document with its number of repetitions."""
    return _mixture(spark, d, mixing.CORPUS)[2]


@query
def p8_byte_goals(spark: SparkSession, d: str) -> DataFrame:
    """The goals of the sources where sizes are bytes, which SQL can count."""
    docs = table(spark, d, "documents").select("source", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    g = mixing.plan(docs, table(spark, d, "mix_targets"), size_col="bytes", total=mixing.CORPUS)
    return g.select("source", F.col("tokens_there").alias("bytes_there"), F.round("goal", 3).alias("goal"), "clamped")


ORACLE["p8_byte_goals"] = """
WITH s AS (
  SELECT t.source, coalesce(target_share, 0) AS w, max_repeats, coalesce((SELECT sum(octet_length(encode(text))) FROM documents d WHERE d.source = t.source), 0)::BIGINT AS n FROM mix_targets t WHERE t.source IS NOT NULL
), l AS (SELECT *, n * max_repeats AS cap, n * max_repeats / w AS r FROM s WHERE w > 0 AND n * max_repeats > 0),
k AS (
  SELECT a.source, a.r, ((SELECT sum(n) FROM l) - coalesce((SELECT sum(cap) FROM l b WHERE b.r < a.r), 0))::DOUBLE / (SELECT sum(w) FROM l b WHERE b.r >= a.r) AS level FROM l a
), v AS (SELECT arg_min(level, r) FILTER (level <= r * (1 + 1e-12)) AS level FROM k)
SELECT s.source, s.n AS bytes_there, round(coalesce(CASE WHEN l.source IS NULL THEN 0 WHEN v.level IS NULL OR v.level * s.w > l.cap * (1 + 1e-12) THEN l.cap ELSE v.level * s.w END, 0)::DOUBLE, 3) AS goal, coalesce(v.level IS NULL OR v.level * s.w > l.cap * (1 + 1e-12), false) AND l.source IS NOT NULL AS clamped
FROM s CROSS JOIN v LEFT JOIN l USING (source)
"""


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of characters that lie in 200 consecutive characters shared with another document."""
    return spans.shared_spans(table(spark, d, "documents"))


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared."""
    docs = table(spark, d, "documents")
    return spans.shared_share(docs, spans.shared_spans(docs))
