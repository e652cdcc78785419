"""Vectors, rounding and small numeric functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _vector(v: Column | Sequence[float]) -> Column:
    return v if isinstance(v, Column) else F.array(*(F.lit(float(x)) for x in v))


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(a, _vector(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """Cosine in double precision; NaN where a norm is 0, null where a vector is null or the lengths differ."""
    nb = F.lit(sum(float(x) ** 2 for x in b) ** 0.5) if not isinstance(b, Column) else norm(b)
    n = norm(a) * nb
    same = F.size(a) == (F.size(b) if isinstance(b, Column) else F.lit(len(b)))
    return F.when(same, F.when(n == 0, F.lit(float("nan"))).otherwise(dot(a, b) / n))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def round4(c: Column) -> Column:
    return F.round(c, 4)


def round1(c: Column) -> Column:
    """One decimal, half up; for values that are not negative."""
    return F.floor(c * 10 + 0.5) / 10


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)


def clamp_limit(n: Column | int | None, default: int, most: int = 1000) -> Column:
    c = F.lit(n) if not isinstance(n, Column) else n
    return F.least(F.when(F.coalesce(c, F.lit(0)) <= 0, default).otherwise(c), F.lit(most))


def limit_of(n: int | None, default: int, most: int = 1000) -> int:
    return min(n if n and n > 0 else default, most)


def backoff_seconds(attempt: Column) -> Column:
    """2^(n+1) seconds, at most 60; the reference's jitter is left out."""
    return F.least(F.pow(F.lit(2.0), attempt + 1), F.lit(60.0))


def ema(ordered_values: Column, seed: float = 3.0, keep: float = 0.75) -> Column:
    """Exponential moving average of an ordered array."""
    return F.aggregate(ordered_values, F.lit(seed), lambda s, x: s * keep + x.cast("double") * (1 - keep))


def retry_hint(remaining: Column, average: Column, least: int = 5) -> Column:
    """Seconds to wait: what the running batch has left, else the average, at least five."""
    return F.greatest(F.lit(least), F.coalesce(remaining, average).cast("int"))


def retry_after_seconds(header: Column, default: float, most: float = 120.0) -> Column:
    """Seconds to wait by a Retry-After header: a positive whole number of seconds, at most two minutes, else the default.
    The reference's jitter is left out."""
    n = F.when(F.regexp_like(header, F.lit(r"^[+-]?\d{1,18}$")), header.cast("bigint"))
    return F.when(n > 0, F.least(n.cast("double"), F.lit(most))).otherwise(F.lit(float(default)))


def elapsed_seconds(begin: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(begin)) / 1_000_000
