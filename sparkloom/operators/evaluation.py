"""Measuring retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from . import prefix


def path_matches(rel: Column, paths: Column) -> Column:
    """Whether a relative path is one of the paths or lies below one; a trailing slash demands that it lies below."""
    inside = lambda p: F.startswith(rel, F.concat(F.rtrim(p, F.lit("/")), F.lit("/")))
    return F.exists(paths, lambda p: inside(p) | ((~F.endswith(p, F.lit("/"))) & (rel == p)))


def retrieval_metrics(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(category, queries, hit_rate, clean_rate, precision) in percent: queries with an expected path among their first k
    results, queries without an anti path there, and expected results among all places.

    results: query, rel_path, rank; queries: query, category, k, expected_paths, anti_paths. A query without results counts
    as missed and clean.
    """
    j = queries.join(results, "query", "left").withColumn("_in", F.col("rank") <= F.col("k"))
    hit = F.coalesce(F.col("_in") & path_matches(F.col("rel_path"), F.col("expected_paths")), F.lit(False))
    anti = F.coalesce(F.col("_in") & path_matches(F.col("rel_path"), F.col("anti_paths")), F.lit(False))
    per = j.groupBy("query", "category", "k").agg(F.sum(hit.cast("int")).alias("h"), F.sum(anti.cast("int")).alias("a"))
    n = F.count("*")
    return per.groupBy("category").agg(
        n.alias("queries"), scores.percent(F.count_if(F.col("h") > 0), n).alias("hit_rate"), scores.percent(F.count_if(F.col("a") == 0), n).alias("clean_rate"), scores.percent(F.sum("h"), F.sum("k")).alias("precision")
    )


def nearest_rank_percentiles(rows: DataFrame, value: str, ps: list[float], keys: list[str]) -> DataFrame:
    """(keys, p, value) at index int(p * (n - 1) + 0.5) of the sorted values.

    Equal values are counted before anything is sorted, and the counts are summed up in two levels over range partitions:
    a key with most of the rows is many tasks. Null values don't count; keys without values give no rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("_c"))
    o = prefix.before(prefix.ordered(counts, keys, ["value"]), keys, [("_b", F.sum("_c"))], F.sum)
    end = F.sum("_c").over(prefix.inside(keys, ["value"]).rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_b", F.lit(0))
    o = o.select(*keys, "value", (end - F.col("_c")).alias("_from"), end.alias("_to"))
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    want = F.array(*(F.struct(F.lit(p).alias("p"), F.floor(F.lit(p) * (F.col("_n") - 1) + 0.5).alias("i")) for p in ps))
    j = o.join(n, same) if keys else o.crossJoin(n)  # without keys: one row
    return j.select(*keys, "value", "_from", "_to", F.explode(want).alias("w")).where("w.i >= _from and w.i < _to").select(*keys, "w.p", "value")


def rank_agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(query, jaccard, recall, tau) of two ranked lists (query, item, rank) of each query.

    Jaccard and recall of the first k items; Kendall's tau over the items of both lists (null for fewer than two). A list
    holds at most k items here, so that a query's lists are small arrays.
    """
    top = lambda d, n: d.where(F.col("rank") <= k).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias(n))
    j = top(a, "x").join(top(b, "y"), "query")
    both = F.array_intersect("x", "y")
    pos = F.transform(both, lambda t: F.array_position(F.col("y"), t))
    n = F.size(pos)
    signs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.aggregate(F.slice(pos, i + 1, n), F.lit(0), lambda s, q: s + F.sign(q - F.element_at(pos, i)).cast("int")))
    tau = F.when(n >= 2, F.aggregate(signs, F.lit(0), lambda s, q: s + q) * 2.0 / (n * (n - 1)))
    return j.select("query", (F.size(both) / F.size(F.array_union("x", "y"))).alias("jaccard"), (F.size(both) / F.size("x")).alias("recall"), tau.alias("tau"))


def cosine_parity(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(pairs, mean, least) cosine of two vector columns."""
    c = scores.cosine(F.col(a), F.col(b))
    return pairs.select(c.alias("c")).where("c is not null").agg(F.count("*").alias("pairs"), F.avg("c").alias("mean"), F.min("c").alias("least"))
