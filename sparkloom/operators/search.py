"""Semantic search: exact nearest vectors, filters, overlap merging and grouping by file."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text

#: Languages up to which each has its own search; factors by which the candidate window widens.
MAX_FANOUT = 4
FACTORS = (2, 4, 8, 16)


def scored(docs: DataFrame, query: Sequence[float], vector_col: str = "embedding", arrow: bool = False) -> DataFrame:
    """The docs with their cosine to one query vector, in double precision and rounded to four decimals.

    A null vector or one of another length has a null score and takes no part in a search. The query vector is a literal
    of the plan, so that no join is needed. ``arrow`` computes with NumPy over Arrow batches instead of in the JVM.
    """
    if not arrow:
        return docs.withColumn("score", scores.round4(scores.cosine(F.col(vector_col), query)))
    q = np.asarray(query, dtype=np.float64)
    qn = float(np.sqrt((q * q).sum()))

    @F.pandas_udf("double")
    def cosine(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            ok = s.map(lambda v: v is not None and len(v) == len(q)).to_numpy(dtype=bool)
            out = np.full(len(s), np.nan)
            if ok.any():
                m = np.stack(s[ok].to_numpy()).astype(np.float64)
                n = np.sqrt((m * m).sum(1)) * qn
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[ok] = np.where(n == 0, np.nan, m @ q / n)
            yield pd.Series(out)

    return docs.withColumn("score", scores.round4(cosine(F.col(vector_col))))


def _usable(s: DataFrame) -> DataFrame:
    return s.where(F.col("score").isNotNull() & ~F.isnan("score"))


def top_k(docs: DataFrame, query: Sequence[float], k: int | None = 10, id_col: str = "doc_id", **kw) -> DataFrame:
    """The k docs nearest to a query, exactly; ties by id. k of 0 or less counts as 10. Plans as TakeOrderedAndProject:
    each task keeps its k best rows."""
    return _usable(scored(docs, query, **kw)).orderBy(F.desc("score"), F.asc(id_col)).limit(k if k and k > 0 else 10)


#: Bytes of query vectors up to which all of them are sent to every task, and of vectors that one packed row holds.
SENT_BYTES = 64 << 20
PACK_BYTES = 4 << 20


def batch_top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", query_id: str = "query_id", vector_col: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank): the k nearest docs of every query of a table, exactly; of equal scores the least ids.

    One pass over the docs: both sides are packed into blocks of vectors, each block of docs meets each block of ``block``
    queries once, as one matrix product, and of every pair of blocks each query keeps its k best docs; these partial lists
    are cut to k per query within the task and again after the shuffle. Query blocks are sent to every task while all of
    them together stay under ``SENT_BYTES``; beyond that, pairs of partitions are dealt out to tasks. No row passes through
    the driver. Null vectors, vectors of no length, and docs of another length than the query take no part.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    q_type = queries.schema[query_id].dataType.simpleString()

    def packed(rows: DataFrame, key: str, kind: str, name: str, most: int | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(1)
                size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                for n in np.unique(size[size > 0]).tolist():  # of one length as a rule
                    at = np.flatnonzero(size == n)
                    m = np.asarray(lists.take(pa.array(at)).flatten().cast(pa.float64())).reshape(-1, n)
                    keys = b.column(0).take(pa.array(at))
                    order = np.asarray(pc.sort_indices(keys))
                    step = most or max(1, PACK_BYTES // (8 * n))
                    for i in range(0, len(at), step):
                        take = order[i : i + step]
                        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(take)], pa.int32()), keys.take(pa.array(take))), pa.array([m[take].tobytes()]), pa.array([n], pa.int32())], [f"{name}s", f"{name}v", f"{name}n"])

        src = rows.select(F.col(key).alias("k"), F.col(vector_col).alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull())
        return src.mapInArrow(run, f"{name}s array<{kind}>, {name}v binary, {name}n int")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ds, dv, dn, qs, qv = (b.column(c)[i] for c in range(5))
                n = dn.as_py()
                unit = lambda v: (x := np.frombuffer(v.as_py()).reshape(-1, n), np.sqrt((x * x).sum(1)))
                (d, dl), (q, ql) = unit(dv), unit(qv)
                ok = np.flatnonzero(dl > 0)
                if not len(ok):
                    continue
                s = np.round(q @ (d[ok] / dl[ok, None]).T / np.where(ql > 0, ql, 1)[:, None], 4)
                least = np.partition(-s, min(k, len(ok)) - 1, axis=1)[:, min(k, len(ok)) - 1]
                row, col = np.nonzero((-s <= least[:, None]) & (ql > 0)[:, None])  # every tie of the k-th
                order = np.lexsort((col, -s[row, col], row))  # docs stand by id
                row, col = row[order], col[order]
                first = np.searchsorted(row, row)
                keep = np.arange(len(row)) - first < k
                row, col = row[keep], col[keep]
                yield pa.RecordBatch.from_arrays([qs.values.take(pa.array(row)), ds.values.take(pa.array(ok[col])), pa.array(s[row, col])], ["q", "d", "s"])

    dq, qq = packed(docs, id_col, id_type, "d", None), packed(queries, query_id, q_type, "q", block)
    shape = queries.agg(F.sum(F.greatest(F.size(vector_col), F.lit(0)) * 8).alias("bytes")).first()
    if (shape["bytes"] or 0) <= SENT_BYTES:
        pairs = dq.join(F.broadcast(qq), F.col("dn") == F.col("qn"))
    else:
        pairs = dq.crossJoin(qq).where("dn = qn")  # a stated query set in blocks against all rows
    got = pairs.select("ds", "dv", "dn", "qs", "qv").mapInArrow(nearest, f"q {q_type}, d {id_type}, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), F.asc("d"))
    ranked = got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("d").alias(id_col), F.col("s").alias("score"), "rank")


def dedup_by_location(hits: DataFrame, keys: Sequence[str] = ("file_path", "start_line", "end_line"), order: Sequence[Column] | None = None) -> DataFrame:
    """One hit per location: the best score, of equals the first by ``order`` (rank)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), *(order or [F.asc("rank")]))
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fan_out(docs: DataFrame, query: Sequence[float], n: int, languages: Sequence[str] = (), id_col: str = "doc_id", arrow: bool = False) -> DataFrame:
    """Candidates with score and rank: none or one language is one search of n; up to four languages are one search of n
    each, made distinct by location; more are one search of n times their number, to be filtered afterwards."""
    s = _usable(scored(docs, query, arrow=arrow))
    by = [F.desc("score"), F.asc(id_col)]
    if len(languages) <= 1 or len(languages) > MAX_FANOUT:
        if len(languages) == 1:
            s = s.where(F.col("language") == languages[0])
        top = s.orderBy(*by).limit(n * max(1, len(languages)))
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # at most n rows times languages
    top = None
    for x in dict.fromkeys(languages):  # each the n best rows of every task, and no task with all rows of a language
        one = s.where(F.col("language") == x).orderBy(*by).limit(n)
        top = one if top is None else top.unionByName(one)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(*by)))
    return dedup_by_location(top, order=[F.asc("language"), F.asc("rank")])


def passing(hits: DataFrame, min_score: float = 0.4, paths: Sequence[str] = (), excludes: Sequence[str] = (), languages: Sequence[str] = ()) -> DataFrame:
    """Hits at or above the score floor, in one of the languages, with one of ``paths`` and none of ``excludes`` in their
    path (case-sensitive substrings)."""
    return hits.where(passes(min_score, paths, excludes, languages))


def passes(min_score: float = 0.4, paths: Sequence[str] = (), excludes: Sequence[str] = (), languages: Sequence[str] = ()) -> Column:
    """The condition of ``passing``."""
    c = F.col("score") >= min_score
    if languages:
        c &= F.col("language").isin(*languages)
    path = F.col("file_path")
    if paths:
        c &= _any([F.contains(path, F.lit(p)) for p in paths])
    if excludes:
        c &= ~_any([F.contains(path, F.lit(p)) for p in excludes])
    return c


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def adaptive_window(docs: DataFrame, query: Sequence[float], limit: int, languages: Sequence[str] = (), id_col: str = "doc_id", arrow: bool = False, **filters) -> DataFrame:
    """Candidates of the first window (2, 4, 8 or 16 times the limit) with enough files, filtered.

    The widest window is ranked once (a bounded number of rows); the number of files that pass among the first n rows
    grows with n, so that the window a loop would stop at is found by one aggregation over it.
    """
    most = limit * FACTORS[-1]
    many = len(languages) > MAX_FANOUT
    post = {"languages": languages} if many else {}
    cand = fan_out(docs, query, most, languages, id_col, arrow).withColumn("_ok", F.coalesce(passes(**filters, **post), F.lit(False)))
    per = len(languages) if many else 1
    every = Window.partitionBy()  # bounded: limit * 16 rows for each language
    n_of = None
    for f in FACTORS:
        n = limit * f
        files = F.size(F.collect_set(F.when(F.col("_ok") & (F.col("rank") <= n * per), F.col("file_path"))).over(every))
        raw = F.count_if(F.col("rank") <= n * per).over(every)
        stop = (files >= limit) | (raw < n) | F.lit(f == FACTORS[-1])
        n_of = F.when(stop, n) if n_of is None else n_of.when(stop, n)
    return cand.withColumn("window", n_of.cast("int")).where("_ok").where(F.col("rank") <= F.col("window") * per).drop("_ok")


_ITEM = "struct<start_line:int,end_line:int,symbol_name:string,chunk_type:string,score:double>"


def merge_overlaps(hits: DataFrame, keys: Sequence[str] = ("file_path",)) -> DataFrame:
    """One row per surviving hit, with the hits it absorbed as ``nested_hits``; score is the best of them.

    In order of size (largest first; then start, score and rank), a hit is absorbed by the first surviving hit that
    strictly contains its range, or that touches it end to end where either has a symbol. Only hits of one unbroken stretch
    of lines can meet, so that the fold runs per stretch; each is folded as one Catalyst expression. Columns needed:
    start_line, end_line, score, symbol_name, chunk_type, rank (ties) and the keys. Hits with a null bound are kept as
    they are, apart from all others. A stretch is one array: a search has at most 16 times its limit of hits in all, and
    hits made distinct by location (``dedup_by_location``) are no more than the stretch's lines have ranges.
    """
    ks = list(keys)
    sized = hits.withColumn("symbol_name", F.coalesce("symbol_name", F.lit("")))
    low, high = F.least("start_line", "end_line"), F.greatest("start_line", "end_line")  # reversed bounds meet what lies between them
    w = Window.partitionBy(*ks).orderBy(low, high.desc(), "rank")
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (low > reach + 1), 1).otherwise(0)
    isles = sized.withColumn("_new", new).withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    isles = isles.withColumn("_isle", F.when(F.col("start_line").isNull() | F.col("end_line").isNull(), -F.col("rank").cast("bigint")).otherwise(F.col("_isle")))
    item = F.struct(
        (F.col("start_line") - F.col("end_line")).alias("o"), "start_line", (-F.col("score")).alias("negative"), "rank", "end_line", F.col("score").cast("double").alias("score"), "symbol_name", "chunk_type",
        *(c for c in hits.columns if c not in {*ks, "start_line", "end_line", "score", "symbol_name", "chunk_type", "rank"}),
    )
    lists = isles.groupBy(*ks, "_isle").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    nested = lambda x: F.struct(x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["symbol_name"].alias("symbol_name"), x["chunk_type"].alias("chunk_type"), x["score"].alias("score")).cast(_ITEM)
    seed = F.array().cast(f"array<struct<p:{lists.schema['xs'].dataType.elementType.simpleString()},best:double,n:array<{_ITEM}>>>")

    def meets(p: Column, x: Column) -> Column:
        contains = (p["start_line"] <= x["start_line"]) & (p["end_line"] >= x["end_line"]) & ((p["start_line"] != x["start_line"]) | (p["end_line"] != x["end_line"]))
        named = (p["symbol_name"] != "") | (x["symbol_name"] != "")
        return contains | (named & ((p["end_line"] + 1 == x["start_line"]) | (x["end_line"] + 1 == p["start_line"])))

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda a: F.coalesce(meets(a["p"], x), F.lit(False))), F.lit(True))
        grown = F.transform(acc, lambda a, i: F.when(i + 1 == at, F.struct(a["p"].alias("p"), F.greatest(a["best"], x["score"]).alias("best"), F.concat(a["n"], F.array(nested(x))).alias("n"))).otherwise(a))
        fresh = F.struct(x.alias("p"), x["score"].alias("best"), F.array().cast(f"array<{_ITEM}>").alias("n"))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(fresh)))

    out = lists.select(*ks, F.explode(F.aggregate("xs", seed, step)).alias("h"))
    rest = [c for c in hits.columns if c not in {*ks, "score", "nested_hits"}]
    return out.select(*ks, *(F.col(f"h.p.{c}").alias(c) for c in rest), F.col("h.best").alias("score"), F.col("h.n").alias("nested_hits"))


def group_by_file(items: DataFrame, limit: int | None = None) -> DataFrame:
    """(file_path, language, best_score, matches): files by best score, then path; matches by start line.

    The language is that of the best-ranked hit. ``matches`` holds the file's surviving hits, of which a search has a
    bounded number.
    """
    fields = [c for c in ("start_line", "end_line", "score", "chunk_type", "symbol_name", "content", "nested_hits") if c in items.columns]
    m = F.array_sort(F.collect_list(F.struct(F.col("start_line").alias("k"), F.col("rank").alias("r"), F.struct(*fields).alias("m"))))
    g = items.groupBy("file_path").agg(F.min_by("language", "rank").alias("language"), F.max("score").alias("best_score"), F.transform(m, lambda x: x["m"]).alias("matches"))
    g = g.orderBy(F.desc("best_score"), F.asc("file_path"))
    return g.limit(limit) if limit else g


def semantic_search(docs: DataFrame, query: Sequence[float], limit: int | None = 10, languages: Sequence[str] = (), min_score: float = 0.4, paths: Sequence[str] = (), excludes: Sequence[str] = (), id_col: str = "doc_id", arrow: bool = False) -> DataFrame:
    """Files that answer a query: adaptive window, filters, overlap merge, grouping by file, limit; one lazy plan.

    ``docs`` needs an id, file_path, start_line, end_line, language, symbol_name, chunk_type and embedding.
    """
    n = scores.limit_of(limit, 10)
    hits = adaptive_window(docs, query, n, languages, id_col, arrow, min_score=min_score, paths=paths, excludes=excludes)
    cols = [c for c in ("file_path", "start_line", "end_line", "score", "symbol_name", "chunk_type", "language", "content", "rank") if c in hits.columns]
    return group_by_file(merge_overlaps(hits.select(*cols)), n)


def text_search(docs: DataFrame, query: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], model: str = "", **kw) -> DataFrame:
    """``semantic_search`` for a text: the query is embedded, after the instruction that the model wants before queries, by
    the embedder that made the docs' vectors (``sources.embedders.embed_column``)."""
    return semantic_search(docs, make()([text.query_instruction(model) + query])[0], **kw)
