"""Pluggable embedding of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ident

Embedder = Callable[[list[str]], list[list[float]]]


def byte_embedder(dim: int = 16) -> Embedder:
    """A deterministic embedder for tests: element j is byte j of the text over 255, padded with zeros."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[b / 255.0 for b in t.encode()[:dim]] + [0.0] * max(0, dim - len(t.encode())) for t in texts]

    return embed


def hashing_embedder(dim: int = 64) -> Embedder:
    """An offline embedder: signed hashes of the text's words, of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if h >> 31 else -1.0
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(n == 0, 1, n)).tolist()

    return embed


def embed_column(rows: DataFrame, text_col: str, out_col: str, make: Callable[[], Embedder], batch: int = 64) -> DataFrame:
    """The rows with the vectors of a text column; the embedder is made once per task and called with batches. A null text
    has a null vector; a count of vectors other than that of texts is an error."""

    @F.pandas_udf("array<float>")
    def vectors(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for s in it:
            have = s[s.notna()]
            got: list[list[float]] = []
            for i in range(0, len(have), batch):
                part = have.iloc[i : i + batch].tolist()
                v = embed(part)
                if len(v) != len(part):
                    raise ValueError(f"{len(part)} texts, {len(v)} vectors")
                got += v
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[s.notna()] = pd.Series(got, index=have.index, dtype=object)
            yield out

    return rows.withColumn(out_col, vectors(F.col(text_col)))


def in_order(vectors: list[dict], n: int) -> list[list[float]]:
    """The vectors of an embedding service's answer ({index, embedding} in any order) by their index; a missing, repeated or
    surplus one is an error."""
    out: list = [None] * n
    for v in vectors:
        i = v["index"]
        if not 0 <= i < n or out[i] is not None:
            raise ValueError(f"index {i} of {n} vectors")
        out[i] = v["embedding"]
    if None in out:
        raise ValueError(f"{n} texts, {len(vectors)} vectors")
    return out


def with_special(ids: Column, first: int, last: int) -> Column:
    """Token ids framed by the first and last special id."""
    return F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last)))


def wire_payloads(requests: DataFrame, value: str = "value", most: int = 50) -> DataFrame:
    """(request_id, files, error) of JSON requests (request_id, value): the files of each payload, or why it is refused (no
    JSON, no files, more than ``most`` files)."""
    shape = "struct<files:array<struct<path:string,content:string,content_hash:string,language:string,size:bigint>>>"
    p = F.from_json(value, shape)["files"]
    error = F.when(p.isNull(), "invalid").when(F.size(p) == 0, "empty").when(F.size(p) > most, "too many files")
    return requests.select("request_id", F.when(error.isNull(), p).alias("files"), error.alias("error"))


def write_collections(docs: DataFrame, root: str) -> None:
    """Vectors as one collection per project: a Parquet table partitioned by the collection's name, so that a search of one
    project reads its partition alone."""
    docs.withColumn("collection", ident.collection_name(F.col("project_path"))).write.mode("overwrite").partitionBy("collection").parquet(root)


def collection(spark, root: str, project: str) -> DataFrame:
    """The vectors of one project, by partition pruning."""
    return spark.read.parquet(root).where(F.col("collection") == ident.collection_name(F.lit(project)))


def collection_counts(docs: DataFrame) -> DataFrame:
    """(collection, vectors)"""
    return docs.groupBy(ident.collection_name(F.col("project_path")).alias("collection")).agg(F.count("*").alias("vectors"))


def drop_collection(docs: DataFrame, project: str) -> DataFrame:
    return docs.where(F.coalesce(ident.collection_name(F.col("project_path")) != ident.collection_name(F.lit(project)), F.lit(True)))
