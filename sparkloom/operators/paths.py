"""Joins of paths with paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors


def overlapping_roots(left: DataFrame, right: DataFrame, path_col: str = "path") -> DataFrame:
    """(left_path, right_path) where one path is a proper ancestor of the other, one trailing slash ignored.

    Each path is joined by equality with the ancestors of the other side, so that no pairs are compared that do not
    overlap. Distinct; null paths overlap nothing.
    """
    clean = lambda d: d.select(F.regexp_replace(F.col(path_col), r"(?<=.)/$", "").alias("p")).where(F.col("p").isNotNull() & (F.col("p") != "")).distinct()
    a, b = clean(left), clean(right)
    up = lambda d: d.select("p", F.explode(ancestors(F.col("p"))).alias("x")).where("x <> p")
    below = up(a).join(b.withColumnRenamed("p", "q"), F.col("x") == F.col("q")).select(F.col("p").alias("left_path"), F.col("q").alias("right_path"))
    above = up(b).withColumnsRenamed({"p": "q"}).join(a, F.col("x") == F.col("p")).select(F.col("p").alias("left_path"), F.col("q").alias("right_path"))
    return below.unionByName(above).distinct()


def longest_root(paths: DataFrame, roots: DataFrame, path_col: str = "path", root_col: str = "root") -> DataFrame:
    """Each path with the longest root that equals it or lies above it, else itself: explode the ancestors, join them with
    the roots by equality, keep the longest."""
    p = paths.select(F.col(path_col).alias("_p")).distinct()
    r = roots.select(F.col(root_col).alias("_r")).distinct()
    j = p.select("_p", F.explode(ancestors(F.col("_p"))).alias("_a")).join(r, F.col("_a") == F.col("_r"))
    best = j.groupBy("_p").agg(F.max_by("_r", F.length("_r")).alias("_best"))
    return p.join(best, "_p", "left").select(F.col("_p").alias(path_col), F.coalesce("_best", "_p").alias("resolved"))


def creatable(projects: DataFrame, candidates: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, status) of distinct candidate project paths: exists, overlaps (it lies above or below a project) or new."""
    clean = lambda d: d.select(F.regexp_replace(F.col(path_col), r"(?<=.)/$", "").alias("path")).where("path <> ''").distinct()
    c, p = clean(candidates), clean(projects)
    over = overlapping_roots(p, c).select(F.col("right_path").alias("path")).distinct().withColumn("_o", F.lit(True))
    j = c.join(p.withColumn("_e", F.lit(True)), "path", "left").join(over, "path", "left")
    return j.select("path", F.when(F.col("_e"), "exists").when(F.col("_o"), "overlaps").otherwise("new").alias("status"))
