"""Cutting oversized items into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4500
OVERLAP = 500

_DECL = re.compile(
    rb"\s*(?:@|#\[|(?:export|default|public|private|protected|static|final|abstract|async|pub|const|unsafe)\s+)*"
    rb"(?:def|class|func|function|fn|interface|enum|struct|type|trait|impl|module|namespace|resource|variable|data|package|#{1,6})\b"
)
_CLOSES = (b"}", b")", b"]")


class RangeMax:
    """Sparse table over strengths: the strongest entry of a range in O(1), the rightmost of equals."""

    def __init__(self, strength: np.ndarray):
        n = len(strength)
        key = strength.astype(np.int64) * (n + 1) + np.arange(n)  # ties break rightward
        self.n, self.rows = n, [key]
        step = 1
        while 2 * step <= n:
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-step], last[step:]))
            step *= 2

    def strongest(self, lo: int, hi: int) -> int:
        """Index of the strongest entry in [lo, hi), or -1 if the range is empty."""
        if lo >= hi:
            return -1
        k = (hi - lo).bit_length() - 1
        row = self.rows[k]
        return int(max(row[lo], row[hi - (1 << k)]) % (self.n + 1))


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets after each line end, and how natural a cut there is.

    4: before a declaration (or the comment, decorator or blank line that leads to one) at the outermost level,
    3: at a blank line or before a nested declaration, 2: before a line indented no deeper than the one before
    (a new statement), 1: any other line end.
    """
    lines = data.split(b"\n")
    at = np.cumsum([len(x) + 1 for x in lines[:-1]]) if len(lines) > 1 else np.zeros(0, np.int64)
    strength = np.ones(len(at), np.int64)
    before = 0
    for i, line in enumerate(lines[:-1]):
        nxt = lines[i + 1]
        here = len(line) - len(line.lstrip()) if line.strip() else before
        before = here
        if not nxt.strip():
            continue
        deep = len(nxt) - len(nxt.lstrip())
        if _DECL.match(nxt):
            strength[i] = 4 if deep == 0 else 3
        elif not line.strip():
            strength[i] = 4 if deep == 0 else 3
        elif deep <= here and not nxt.lstrip().startswith(_CLOSES):
            strength[i] = 2
    return at, strength


def cuts(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) byte ranges that cover ``data`` in order, each of at most ``limit`` bytes.

    Each cut is the strongest line boundary of the permissible window (the upper half of the limit first, then
    the rest of it), the rightmost of equals; without one, the last character boundary within the limit. The
    next piece steps back over at most ``overlap`` bytes: whole lines where the window has line ends, else whole
    characters.
    """
    n = len(data)
    if n <= limit:
        return [(0, n)]
    at, strength = boundaries(data)
    index = RangeMax(strength)
    out, start, done = [], 0, 0  # everything before done is in a piece
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        hi = int(np.searchsorted(at, start + limit, "right"))
        i = -1
        for least in (max(done, start + limit // 2), done):
            i = index.strongest(int(np.searchsorted(at, least, "right")), hi)
            if i >= 0:
                break
        if i >= 0:
            end = int(at[i])
        else:
            end = start + limit
            while data[end] & 0xC0 == 0x80:
                end -= 1
            if end <= done:  # only where limit is below one character
                raise ValueError("limit is too small for a character")
        out.append((start, end))
        done = end
        j = int(np.searchsorted(at, end - overlap, "left"))
        nxt = int(at[j]) if j < len(at) and at[j] <= end else end
        if nxt == end and i < 0:  # inside a line: repeat characters
            nxt = end - overlap
            while data[nxt] & 0xC0 == 0x80:
                nxt += 1
        start = nxt if nxt > start else end


def split_oversized(items: DataFrame, id_col: str, text_col: str, start_col: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP, once: bool = True) -> DataFrame:
    """(id, piece_no, content, start_line, end_line, overlap_bytes, cut_kind) of items larger than ``limit`` bytes.

    Cuts are found with a sparse-table range-maximum index over boundary strengths (see ``cuts``). Dropping the
    first ``overlap_bytes`` bytes of each piece and joining the pieces gives the text back. ``cut_kind`` is
    ``line`` if every line with its end fits the limit, else ``inside``. Items within the limit, and null texts,
    give no rows. A null start line counts as 1. Repeated rows of one id give the same pieces once (with
    ``once=False`` again for each row, without the shuffle that makes them distinct); an empty input gives an empty
    result; extra columns are ignored. Only oversized items leave the JVM.
    """
    if overlap * 2 > limit:
        raise ValueError("overlap must be at most half of limit")
    first = F.coalesce(F.col(start_col), F.lit(1)) if start_col else F.lit(1)
    big = items.where(F.octet_length(F.col(text_col)) > limit).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), first.cast("int").alias("_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                cols: list[list] = [[] for _ in range(7)]
                part = b.slice(i, 200)
                for key, text, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = text.encode()
                    kind = "line" if max(map(len, data.split(b"\n"))) < limit or _lines_fit(data, limit) else "inside"
                    done, at, before = 0, 0, 0
                    for no, (s, e) in enumerate(cuts(data, limit, overlap)):
                        before += data.count(b"\n", at, s)
                        at = s
                        inner = data.count(b"\n", s, e) - (data[e - 1 : e] == b"\n")
                        for c, v in zip(cols, (key, no, data[s:e].decode(), line + before, line + before + inner, done - s, kind)):
                            c.append(v)
                        done = e
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()])], out_names)

    out_names = [id_col, "piece_no", "content", "start_line", "end_line", "overlap_bytes", "cut_kind"]
    kind = items.schema[id_col].dataType.simpleString()
    out = big.mapInArrow(run, f"`{id_col}` {kind}, piece_no int, content string, start_line int, end_line int, overlap_bytes int, cut_kind string")
    return out.dropDuplicates([id_col, "piece_no"]) if once else out


def _lines_fit(data: bytes, limit: int) -> bool:
    lines = data.split(b"\n")
    return all(len(x) < limit for x in lines[:-1]) and len(lines[-1]) <= limit
