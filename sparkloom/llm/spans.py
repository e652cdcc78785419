"""Long exact spans shared between documents, by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import cover_and_gaps
from ..session import materialize

K = 200
M = 64
#: Super-k-mers from which a minimiser's bucket is hot and is spread by window instead of gathered (about 300 characters
#: each)
HOT_ROWS = 20_000

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _windows(codes: np.ndarray, base: np.uint64, k: int) -> np.ndarray:
    """Polynomial hash of each run of k codes, by doubling: h(2n)[i] = h(n)[i] * base^n + h(n)[i + n]."""
    power = {1: _mix(codes.astype(np.uint64) + np.uint64(1))}
    w = {1: base}
    n = 1
    while 2 * n <= k:
        h = power[n]
        power[2 * n] = h[: len(h) - n] * w[n] + h[n:]
        with np.errstate(over="ignore"):
            w[2 * n] = w[n] * w[n]
        n *= 2
    out, have = power[n], n
    rest = k - n
    for p in sorted((q for q in power if q & rest), reverse=True):
        right = power[p][have:]
        m = min(len(out), len(right))
        out = out[:m] * w[p] + right[:m]
        have += p
    return out[: len(codes) - k + 1]


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[: len(x) - n], x[n:])
        n *= 2
    return x if n == w else np.minimum(x[: len(x) - (w - n)], x[w - n :])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def super_kmers(codes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, last window) of each run of consecutive windows that share a minimiser."""
    if len(codes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _slide_min(_mix(_windows(codes, _A, m)), k - m + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[first], first, np.append(first[1:] - 1, len(least) - 1)


def _window_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, hash a, hash b) of every k-window of the texts."""
    codes = [_codes(t) for t in texts]
    lens = np.fromiter(map(len, codes), np.int64, len(codes))
    every = np.concatenate(codes)
    row = np.repeat(np.arange(len(codes)), lens - k + 1)
    begin = np.cumsum(lens) - lens
    inner = np.cumsum(lens - k + 1) - (lens - k + 1)
    offset = np.arange(len(row)) - inner[row]
    at = begin[row] + offset
    return row, offset, _windows(every, _A, k)[at], _windows(every, _B, k)[at]


def _shared_in_bucket(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of the runs of windows that another id's row has too; t holds whole buckets."""
    row, offset, a, b = _window_hashes(t.column("_s").to_pylist(), k)
    ids = t.column("_id").combine_chunks().dictionary_encode()
    who = np.asarray(ids.indices)[row]
    order = np.argsort(a, kind="stable")
    if len(a) and (np.diff(a[order]) == 0).any() and (b[order][1:] != b[order][:-1])[np.diff(a[order]) == 0].any():
        order = np.lexsort((b, a))  # equal first halves of different windows
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    w = who[order]
    many = np.minimum.reduceat(w, heads) != np.maximum.reduceat(w, heads)
    hit = np.zeros(len(row), bool)
    hit[order] = np.repeat(many, np.diff(np.append(heads, len(a))))
    pos = np.flatnonzero(hit)
    if not len(pos):
        return pos, pos, pos
    new = np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (row[pos[1:]] != row[pos[:-1]])])
    first = pos[new]
    last = pos[np.append(np.flatnonzero(new)[1:] - 1, len(pos) - 1)]
    begin = np.asarray(t.column("_p"))[row[first]]
    return row[first], begin + offset[first], begin + offset[last] + k


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, start_char, end_char): the longest runs of characters that lie in ``k`` consecutive characters which
    also occur in a text of another id; 0-based code points, end exclusive; runs that touch are one.

    1. Equal texts are grouped by digest; members of a group of two ids or more are wholly shared, and one
       representative of each group goes on, so that any number of copies is one text from here.
    2. Every text is cut into super-k-mers: runs of consecutive k-windows with the same minimiser (the least
       hash of an m-mer). First only (minimiser, id) pairs are shuffled; a minimiser of a single id ends here.
    3. For the others the super-k-mer travels as one packed string to its minimiser's bucket, where its windows
       are sorted by a 128-bit hash and counted. Equal windows have equal minimisers, so that each window is
       decided in exactly one bucket.
    4. A bucket of more than ``hot_rows`` super-k-mers (boilerplate of a large part of the corpus) is never gathered:
       its windows are spread by their own hash with map-side combination and joined back to the shared ones.
    5. The ranges of each id are merged by the interval sweep.

    Null texts and texts under ``k`` characters give no rows; rows without an id are ignored; repeated rows count
    once, and rows of one id with different texts count as one document. Any Unicode; an empty input gives an
    empty result; extra columns are ignored.
    """
    idt = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.col("_id").isNotNull() & (F.char_length("_t") >= k))
    keyed = materialize(d.select("_id", F.unhex(F.md5("_t")).alias("_h"), F.char_length("_t").alias("_n")))
    groups = keyed.groupBy("_h", "_n").agg(F.min("_id").alias("_rep"), (F.min("_id") != F.max("_id")).alias("_x"))
    whole = keyed.join(groups.where("_x"), ["_h", "_n"], "left_semi").select("_id", F.lit(0).cast("bigint").alias("s"), (F.col("_n") - 1).cast("bigint").alias("e"))
    reps = groups.select(F.col("_rep").alias("_id"), F.col("_h").alias("_rh"), "_x")
    # the digest must not become a join key: the texts then stay partitioned by id for the second join
    texts = d.join(reps, "_id").where(F.coalesce(F.unhex(F.md5("_t")) == F.col("_rh"), F.lit(False))).select("_id", "_t", "_x")

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(super_kmers(_codes(t), k, m)[0], return_counts=True) for t in b.column("_t").to_pylist()]
            off = pa.array(np.cumsum([0, *(len(x) for x, _ in found)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate([f[i] for f in found] or [np.zeros(0)]).astype(np.uint64).view(np.int64))) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_h"), *lists], ["_id", "_h", "_ms", "_cs"])

    mins = d.select("_id", F.unhex(F.md5("_t")).alias("_h"), "_t").mapInArrow(minimisers, f"_id {idt}, _h binary, _ms array<bigint>, _cs array<bigint>")
    pairs = mins.join(reps, "_id").where(F.col("_h") == F.col("_rh")).select("_id", F.explode(F.arrays_zip("_ms", "_cs")).alias("x"))
    pairs = materialize(pairs.select("_id", F.col("x._ms").alias("_m"), F.col("x._cs").cast("int").alias("_n")))
    # a bucket's size is that of its super-k-mers: one text may have very many with one minimiser
    several = pairs.groupBy("_m").agg(F.min("_id").alias("a"), F.max("_id").alias("z"), F.sum("_n").alias("c")).where("a <> z")
    several = materialize(several.select("_m", (F.col("c") > hot_rows).alias("_hot")))
    some_hot = not several.where("_hot").isEmpty()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, starts, parts = [], [], [], []
            want = b.column("_w")
            wm, off = np.asarray(want.flatten()), np.asarray(want.offsets) - want.offsets[0].as_py()
            for i, t in enumerate(b.column("_t").to_pylist()):
                key, first, last = super_kmers(_codes(t), k, m)
                key = key.view(np.int64)
                mine = wm[off[i] : off[i + 1]]
                at = np.minimum(np.searchsorted(mine, key), len(mine) - 1)
                for j in np.flatnonzero(mine[at] == key).tolist():
                    keys.append(key[j])
                    rows.append(i)
                    starts.append(first[j])
                    parts.append(t[first[j] : last[j] + k])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column("_id").take(take), b.column("_x").take(take), pa.array(starts, pa.int64()), pa.array(parts, pa.string())], ["_m", "_id", "_x", "_p", "_s"])

    def packed(which: str) -> DataFrame:
        wanted = pairs.join(several.where(which).select("_m"), "_m").groupBy("_id").agg(F.sort_array(F.collect_set("_m")).alias("_w"))
        return texts.join(wanted, "_id").select("_id", "_t", "_x", "_w").mapInArrow(pack, f"_m bigint, _id {idt}, _x boolean, _p bigint, _s string")

    def count_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            row, s, e = _shared_in_bucket(t, k)
            keep = ~np.asarray(t.column("_x").cast(pa.int8())).astype(bool)[row]
            ids = t.column("_id").combine_chunks().take(pa.array(row[keep]))
            return pa.RecordBatch.from_arrays([ids, pa.array(s[keep]), pa.array(e[keep] - 1)], ["_id", "s", "e"])

        for b in batches:
            if not b.num_rows:
                continue
            ms = np.asarray(b.column("_m"))
            cut = int(np.searchsorted(ms, ms[-1], "left"))
            if cut or (pending and pending[-1].column("_m")[-1].as_py() != ms[0]):
                yield done(pa.Table.from_batches([*pending, b.slice(0, cut)]))
                pending = []
            pending.append(b.slice(cut))
        if pending:
            yield done(pa.Table.from_batches(pending))

    cold = packed("not _hot").repartition("_m").sortWithinPartitions("_m").mapInArrow(count_sorted, f"_id {idt}, s bigint, e bigint")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                row, offset, x, y = _window_hashes(part.column("_s").to_pylist(), k)
                take = pa.array(row)
                start = np.asarray(part.column("_p"))[row] + offset
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), part.column("_id").take(take), part.column("_x").take(take), pa.array(start)], ["_a", "_b", "_id", "_x", "s"])

    parts = whole.unionByName(cold)
    if some_hot:
        spread = packed("_hot").mapInArrow(windows, f"_a bigint, _b bigint, _id {idt}, _x boolean, s bigint")
        twice = spread.groupBy("_a", "_b").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo <> hi").select("_a", "_b")
        parts = parts.unionByName(spread.where("not _x").join(twice, ["_a", "_b"], "left_semi").select("_id", "s", (F.col("s") + k - 1).alias("e")))

    runs = cover_and_gaps(parts, ["_id"], "s", "e").where("kind = 'period'")
    return runs.select(F.col("_id").alias(id_col), F.col("s").alias("start_char"), (F.col("e") + 1).alias("end_char"))


def shared_share(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, shared_chars, shared_share) of every row of docs, 0 where nothing is shared; a null or empty
    text has 0 characters and a null share."""
    per = spans.groupBy(id_col).agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    n = docs.select(id_col, F.coalesce(F.char_length(text_col), F.lit(0)).cast("bigint").alias("n_chars"))
    return n.join(per, id_col, "left").select(id_col, "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars"), 6)).alias("shared_share"))
