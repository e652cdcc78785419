"""Merging overlapping integer ranges per key and listing the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines per block of the two-level prefix sum. A (key, block) group has at most this many rows after
#: the pre-aggregation, however many ranges the key has.
BLOCK = 1024


def ranges_of_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_line, end_line): the bounds of each hit and of each of its nested hits that reach out of it."""
    own = F.struct(F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    # a nested range inside its hit's own adds nothing to what is covered
    inside = lambda n: F.coalesce((F.col("start_line") <= n["start_line"]) & (n["end_line"] <= F.col("end_line")), F.lit(False))
    beyond = F.filter(F.col("nested_hits"), lambda n: ~inside(n))
    nested = F.transform(beyond, lambda n: F.struct(n["start_line"].alias("s"), n["end_line"].alias("e")))
    all_of = F.concat(F.array(own), F.coalesce(nested, F.array().cast("array<struct<s:int,e:int>>")))
    rows = hits.select(*keys, F.explode(all_of).alias("r"))
    return rows.select(*keys, F.col("r.s").alias("start_line"), F.col("r.e").alias("end_line"))


def cover_and_gaps(ranges: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line", block: int = BLOCK) -> DataFrame:
    """Continuous periods and the gaps between them: (keys, kind, start, end), bounds inclusive.

    Sweep line: each range becomes +1 at its start and -1 after its end; equal positions of a key are summed
    before the shuffle, and a prefix sum counts the active ranges. The prefix sum has two levels (inside a
    block of ``block`` positions, and over the blocks' totals), so that one key with a third of all rows is
    spread over many tasks: a window holds the positions of one block, or one row for each block that a key occupies,
    which is at most its length over ``block``, however many ranges it has.

    Ranges that touch (one ends where the next begins, less one) form one period. A range with a null bound
    or with its end before its start counts for nothing; repeated ranges change nothing; a null key is a key
    of its own; an empty input gives an empty result. Extra columns are ignored.
    """
    tag = "_iv_"  # own columns cannot clash with the keys
    k = [F.col(c).alias(f"{tag}k{i}") for i, c in enumerate(keys)]
    kn = [f"{tag}k{i}" for i in range(len(keys))]
    good = ranges.select(*k, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e")).where("_s <= _e")
    ends = F.array(F.struct(F.col("_s").alias("p"), F.lit(1).alias("d")), F.struct((F.col("_e") + 1).alias("p"), F.lit(-1).alias("d")))
    ev = (
        good.select(*kn, F.explode(ends).alias("x"))
        .select(*kn, F.col("x.p").alias("p"), F.col("x.d").alias("d"), F.floor(F.col("x.p") / block).alias("b"))
        .groupBy(*kn, "b", "p")
        .agg(F.sum("d").alias("d"))
        .where("d <> 0")
    )
    over_blocks = Window.partitionBy(*kn).orderBy("b")
    base = ev.groupBy(*kn, "b").agg(F.sum("d").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(*kn, "b").orderBy("p")
    run = _same_keys(ev, base.select(*kn, "b", "base"), [*kn, "b"]).withColumn("n", F.col("base") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    edge = run.where("n = 0 or n = d").select(*kn, "b", "p", (F.col("n") > 0).alias("opens"))
    first = edge.groupBy(*kn, "b").agg(F.min("p").alias("f")).withColumn("after", F.lead("f").over(over_blocks))
    paired = _same_keys(edge, first.select(*kn, "b", "after"), [*kn, "b"]).withColumn("q", F.coalesce(F.lead("p").over(inside), F.col("after")))
    kind: Column = F.when(F.col("opens"), "period").otherwise("gap")
    to = ranges.schema[start].dataType
    return paired.where("q is not null").select(
        *(F.col(a).alias(c) for a, c in zip(kn, keys)), kind.alias("kind"), F.col("p").cast(to).alias(start), (F.col("q") - 1).cast(to).alias(end)
    )


def _same_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on null-safe equality; ``right`` has each key once."""
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in on), *(c for c in right.columns if c not in on))
    cond = None
    for c in on:
        x = left[c].eqNullSafe(r[f"r_{c}"])
        cond = x if cond is None else cond & x
    return left.join(r, cond).drop(*(f"r_{c}" for c in on))
