"""Encoding a whole corpus with a public byte-level BPE vocabulary, decoding, and token counts."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize

#: Where the vocabulary files lie on every node; a parameter of each operator, never part of the repository.
TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k"

# Unicode White_Space, and the public pre-tokenization pattern of the vocabulary with that
# class spelled out, so that Java and Python agree on it.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
JAVA_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Bytes of text that one block of the position join holds.
BLOCK_BYTES = 2 << 20


@functools.lru_cache(maxsize=4)
def _ranks(name: str, folder: str) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def _encoding(name: str, folder: str):
    import tiktoken

    # the pattern is not used: words arrive split, and each is encoded as one piece
    return tiktoken.Encoding(name, pat_str=r"[\s\S]+", mergeable_ranks=_ranks(name, folder), special_tokens={})


@functools.lru_cache(maxsize=1)
def _splitter():
    import regex

    space = SPACE.replace(r"\x{85}", r"\x85").replace(r"\x{a0}", r"\xa0")
    for x in ("1680", "2000", "200a", "2028", "2029", "202f", "205f", "3000"):
        space = space.replace(rf"\x{{{x}}}", rf"\u{x}")
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|[{space}]+(?![^{space}])|[{space}]+").findall


class _Lengths(dict):
    """word -> number of its tokens, found on first use; kept up to a bound."""

    LIMIT = 400_000

    def __init__(self, name: str, folder: str):
        super().__init__()
        self.enc = _encoding(name, folder)

    def __missing__(self, word: str) -> int:
        n = len(self.enc.encode_ordinary(word))
        if len(self) < self.LIMIT:
            self[word] = n
        return n


def words(text: Column) -> Column:
    """The pre-tokenization words of a text, in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, ids array<int>): the token ids of every text, without special tokens.

    A distinct-word table: the texts are split into words in Spark, once; the words are made distinct per block of
    documents and then over the corpus, and each distinct word is encoded once. The ids go back to the blocks and are
    joined to the words of each document by position; no text is split or encoded a second time, and a word that the table
    lacks is an error. Only distinct (block, word) pairs and the texts with their words' lengths are shuffled, not single
    occurrences of words. A block holds about ``block_bytes`` of text, however often a word occurs.

    A null and an empty text both get an empty list; strings that look like special tokens are ordinary
    text; each input row gives one row (repeated rows stay repeated); an empty input gives an empty result;
    extra columns are ignored.
    """
    seen = Observation()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows are numbered as they are written: ids may be null or repeated
    d = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_n"), words(text).alias("_ws"), F.octet_length(text).alias("_z"))
    d = materialize(d.observe(seen, F.sum("_z").alias("bytes")).drop("_z"))
    blocks = int((seen.get["bytes"] or 0) // block_bytes) + 1
    d = d.withColumn("_b", F.pmod(F.xxhash64("_n"), F.lit(blocks)))
    pairs = materialize(d.select("_b", F.explode(F.array_distinct("_ws")).alias("_w")).distinct())  # read twice

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(name, folder)
        kind = pa.list_(pa.int32())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.encode_ordinary(w) for w in b.column(0).to_pylist()], kind)], ["_w", "_ids"])

    table = pairs.select("_w").distinct().mapInArrow(encode_words, "_w string, _ids array<int>")
    back = pairs.join(table, "_w").select(F.col("_b").alias("_rb"), "_w", "_ids")

    def by_position(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, lists = _whole(left.column("_t")), _whole(left.column("_ls"))
        size = np.asarray(pc.list_value_length(lists))
        # the texts lie one after the other, and their words fill them: the lengths are the words' places
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if len(texts) else 0
        places = np.concatenate([[at], at + np.cumsum(np.asarray(lists.flatten()), dtype=np.int64)]).astype(np.int32)
        flat = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), texts.buffers()[2] or pa.py_buffer(b""))
        found = pc.index_in(flat, value_set=_whole(right.column("_w")))
        if found.null_count:
            raise ValueError("a word without token ids")
        ids = _whole(right.column("_ids")).take(found)
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids)), dtype=np.int64)])
        offsets = ends[np.concatenate([[0], np.cumsum(size, dtype=np.int64)])].astype(np.int32)
        return pa.table({id_col: left.column("_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), ids.flatten())})

    id_type = docs.schema[id_col].dataType.simpleString()
    d = d.select("_b", "_id", F.array_join("_ws", "").alias("_t"), F.transform("_ws", lambda w: F.octet_length(w)).alias("_ls"))
    return d.groupBy("_b").cogroup(back.groupBy("_rb")).applyInArrow(by_position, f"`{id_col}` {id_type}, ids array<int>")


def _whole(c: pa.ChunkedArray) -> pa.Array:
    """A column in one piece."""
    x = c.combine_chunks()
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) and x.num_chunks else pa.array([], c.type) if isinstance(x, pa.ChunkedArray) else x


def pieces(spark, name: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(token_id int, piece binary): the vocabulary as a table; its size is that of the vocabulary file."""
    return spark.createDataFrame([(v, bytearray(k)) for k, v in _ranks(name, folder).items()], "token_id int, piece binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, text): ids joined to their pieces and concatenated by position. The id column must be a key.

    An empty or null list gives an empty text; an id outside the vocabulary gives a null text.
    """
    vocab = F.broadcast(pieces(encoded.sparkSession, name, folder))  # bounded by the vocabulary
    rows = encoded.select(F.col(id_col).alias("_id"), F.posexplode_outer(ids_col).alias("_p", "token_id"))
    joined = rows.join(vocab, "token_id", "left").withColumn("bad", F.col("token_id").isNotNull() & F.col("piece").isNull())
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_p", F.hex("piece").alias("h")))), lambda x: x["h"])
    out = joined.groupBy("_id").agg(F.max("bad").alias("bad"), F.decode(F.unhex(F.array_join(parts, "")), "utf-8").alias("t"))
    return out.select(F.col("_id").alias(id_col), F.when(~F.col("bad"), F.coalesce("t", F.lit(""))).alias("text"))


def token_counts(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", name: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR) -> DataFrame:
    """The input with the number of tokens of each text (0 for null and empty); no shuffle."""

    @F.pandas_udf("bigint")
    def counted(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get, split = _Lengths(name, folder).__getitem__, _splitter()
        for s in it:
            yield pd.Series([sum(map(get, split(t))) if t else 0 for t in s], dtype="int64")

    return docs.withColumn(out_col, counted(F.col(text_col)))
