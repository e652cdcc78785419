"""Running values over ordered rows of a key, in two levels, so that one key with very many rows is many tasks.

Rows are range-partitioned by key and order and written once; within a partition a window runs over the rows of a key, and
over the partitions' totals (one row per key and partition) a second one. Rows that are equal in key and order lie in one
partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_PART = "_part"


def ordered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with the number of their range partition (``_part``), which grows with the order within each key."""
    return materialize(rows.repartitionByRange(*keys, *order).withColumn(_PART, F.spark_partition_id()))


def inside(keys: Sequence[str], order: Sequence[Column | str]):
    """The window over the rows of a key within one partition."""
    return Window.partitionBy(*keys, _PART).orderBy(*order)


def before(rows: DataFrame, keys: Sequence[str], of: Sequence[tuple[str, Column]], over) -> DataFrame:
    """The rows of ``ordered`` with what came in the key's earlier partitions.

    ``of`` names columns and the aggregate of a partition that each accumulates; ``over`` accumulates it again over the
    partitions before (``F.sum``, ``F.max``, ``F.last``). A column is null for the key's first partition.
    """
    per = rows.groupBy(*keys, _PART).agg(*(a.alias(n) for n, a in of))
    w = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    per = per.select(*(F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)), F.col(_PART).alias("_k_p"), *(over(n).over(w).alias(n) for n, _ in of))
    same = F.col(_PART) == F.col("_k_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return rows.join(per, same).drop("_k_p", *(f"_k_{i}" for i in range(len(keys))))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """The rows with their position (from 0) within their key."""
    r = before(ordered(rows, keys, order), keys, [("_n", F.count("*"))], F.sum)
    at = F.row_number().over(inside(keys, order)) - 1 + F.coalesce("_n", F.lit(0))
    return r.withColumn(out, at).drop("_n", _PART)


def segmented(rows: DataFrame, keys: Sequence[str], at: str, opens: float, out: str) -> DataFrame:
    """The rows with the number of their segment (from 1) within their key: a segment opens with a key's first row and
    after a gap of ``opens`` or more in ``at``, a number. Rows at one time are of one segment."""
    r = before(ordered(rows, keys, [at]), keys, [("_last", F.max(at))], F.max)
    w = inside(keys, [at])
    prior = F.coalesce(F.lag(at).over(w), F.col("_last"))
    r = r.withColumn("_new", F.when(prior.isNull() | (F.col(at) - prior >= opens), 1).otherwise(0)).drop("_last")
    r = before(r, keys, [("_sum", F.sum("_new"))], F.sum)
    run = F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)) + F.coalesce("_sum", F.lit(0))
    return r.withColumn(out, run).drop("_new", "_sum", _PART)
