"""Layered settings, drift and the relational parts of identity."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layered(db: Column, env: Column, recommended: Column, zero_is_unset: bool = True) -> tuple[Column, Column]:
    """(value, source): the database's value, else the environment's, else the recommended one; 0 and an empty text count
    as unset unless ``zero_is_unset`` is False."""
    if zero_is_unset:
        blank = lambda c: F.when(c.cast("string").isin("0", ""), None).otherwise(c)
        d, e = blank(db), blank(env)
    else:
        d, e = db, env
    return F.coalesce(d, e, recommended), F.when(d.isNotNull(), "db").when(e.isNotNull(), "env").otherwise("recommended")


def patched(current: Column, patch: Column) -> Column:
    """null keeps, 0 or an empty text clears, anything else sets."""
    return F.when(patch.isNull(), current).when(patch.cast("string").isin("0", ""), None).otherwise(patch)


def drift(indexed_with: Column, current: Column | str) -> Column:
    """unknown, stale or current: whether an index was made with the current model."""
    c = current if isinstance(current, Column) else F.lit(current)
    return F.when(indexed_with.isNull(), "unknown").when(indexed_with != c, "stale").otherwise("current")


def project_settings(projects: DataFrame, default_size: int = 524_288) -> DataFrame:
    """(host_path, exclude_patterns, max_file_size) with defaults where the settings are empty or no JSON."""
    s = F.from_json("settings", "struct<exclude_patterns:array<string>,max_file_size:bigint>", {"mode": "PERMISSIVE"})
    return projects.select("host_path", F.coalesce(s["exclude_patterns"], F.array().cast("array<string>")).alias("exclude_patterns"), F.coalesce(s["max_file_size"], F.lit(default_size)).alias("max_file_size"))


def counts_per_owner(owners: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """Owners with the number of rows of each child table and 0 where there are none; children are aggregated before the
    join."""
    out = owners
    for name, c in children.items():
        out = out.join(c.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.fillna(0, list(children))


def valid_keys(keys: DataFrame, owners: DataFrame) -> DataFrame:
    """Keys that are not revoked, of owners who are not disabled: key_hash, owner_id, revoked_at; owner_id, disabled_at."""
    return keys.where("revoked_at is null").join(owners.where("disabled_at is null").select("owner_id"), "owner_id", "left_semi")


def encode_languages(langs: list[str]) -> str:
    return json.dumps(langs, ensure_ascii=False)
