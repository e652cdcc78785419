"""Cutting texts into chunks."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import spread
from . import prefix, structure

# Bytes of a sliding window and of the overlap of two, bytes of the largest chunk, lines of the longest shell function.
WINDOW = 4000
OVERLAP = 500
MAX_CHUNK = 4500
BASH_LINES = 500


def sliding_windows(files: DataFrame, id_cols: list[str], text_col: str, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(ids, idx, content binary, start_line, end_line) of overlapping byte windows of each text.

    Windows are counted in UTF-8 bytes and may cut a character; lines count from 1. A null or empty text has none; a text
    within ``size`` has one. All in the JVM, one pass over the text for each of its windows' slices.
    """
    b = F.encode(F.col(text_col), "utf-8")
    n = F.octet_length(b)
    step = size - overlap
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
    d = files.where(F.octet_length(F.col(text_col)) > 0).select(*id_cols, b.alias("_b"), n.alias("_n"), last.cast("int").alias("_l"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("_l"))).alias("idx"))
    newlines = lambda x: F.octet_length(F.regexp_replace(F.decode(x, "iso-8859-1"), r"[^\n]", ""))
    d = d.select(*id_cols, "idx", F.expr(f"substring(_b, idx * {step} + 1, {size})").alias("content"), F.expr(f"substring(_b, 1, idx * {step})").alias("_before"))
    start = newlines(F.col("_before")) + 1
    return d.select(*id_cols, "idx", "content", start.cast("int").alias("start_line"), (start + newlines(F.col("content"))).cast("int").alias("end_line"))


def line_gaps(ranges: DataFrame, totals: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line", total: str = "lines") -> DataFrame:
    """(keys, start, end): runs of the lines 1..total of each key that no range covers. A null or reversed range covers
    nothing; a key without ranges is one gap; a key without lines none. Ranges with equal starts are reduced to the longest
    before the sweep, and how far the earlier ones reach is found in two levels, so that a key with very many ranges is
    many tasks."""
    good = ranges.where(F.col(start) <= F.col(end)).groupBy(*keys, F.col(start).alias("_s")).agg(F.max(end).alias("_e"))
    lines = totals.where(F.col(total) > 0).groupBy(*keys).agg(F.max(total).alias("_n"))
    tail = lines.select(*keys, (F.col("_n") + 1).alias("_s"), (F.col("_n") + 1).alias("_e"))
    o = prefix.before(prefix.ordered(good.unionByName(tail), keys, ["_s"]), keys, [("_b", F.max("_e"))], F.max)
    w = prefix.inside(keys, ["_s"]).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.coalesce(F.max("_e").over(w), F.lit(0)), F.coalesce("_b", F.lit(0)))
    g = o.select(*keys, "_s", (reach + 1).alias("_f")).join(lines, list(keys))
    g = g.select(*keys, F.col("_f").cast("int").alias(start), (F.least(F.col("_s"), F.col("_n") + 1) - 1).cast("int").alias(end))
    return g.where(F.col(start) <= F.col(end))


def module_chunks(files: DataFrame, gaps: DataFrame, keys: list[str], text_col: str = "content") -> DataFrame:
    """The gaps that are not blank, as chunks of type module with their lines."""
    j = gaps.join(files.select(*keys, F.col(text_col).alias("_t"), "language"), keys)
    body = F.array_join(F.slice(F.split("_t", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return j.select(*keys, body.alias("content"), F.lit("module").alias("chunk_type"), "start_line", "end_line", "language").where(F.trim("content", F.lit(" \t\n\r")) != "")


def pack_lines(chunks: DataFrame, limit: int = MAX_CHUNK) -> DataFrame:
    """Chunks with those over ``limit`` bytes cut by greedy packing of whole lines.

    A cut comes before the line that would bring the piece to ``limit`` bytes; the first piece keeps type, symbol and
    signature, the others are anonymous blocks; all keep the parent; one huge line stays whole; the last piece ends where
    the chunk ends. One Catalyst fold over the lines' lengths. Columns: content, start_line, end_line, chunk_type,
    symbol_name, signature and any others; adds piece_no.
    """
    ls = F.split("content", "\n")
    size = F.transform(ls, lambda x: F.octet_length(x))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("b"), F.array().cast("array<struct<s:int,n:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        joined = a["b"] + F.when(a["n"] > 0, 1).otherwise(0) + x
        cut = (joined >= limit) & (a["n"] > 0)
        return F.struct(
            F.when(cut, a["at"] + a["n"]).otherwise(a["at"]).alias("at"), F.when(cut, 1).otherwise(a["n"] + 1).alias("n"), F.when(cut, x).otherwise(joined).alias("b"),
            F.when(cut, F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), a["n"].alias("n"))))).otherwise(a["out"]).alias("out"),
        )

    done = F.aggregate(size, zero, step, lambda a: F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), a["n"].alias("n")))))
    whole = F.array(F.struct(F.lit(0).alias("s"), F.size(ls).alias("n")))
    p = chunks.withColumn("_ls", ls).withColumn("_p", F.when(F.octet_length("content") > limit, done).otherwise(whole))
    p = p.select("*", F.posexplode("_p").alias("piece_no", "_x"))
    first, last = F.col("piece_no") == 0, F.col("piece_no") + 1 == F.size("_p")
    out = {
        "content": F.array_join(F.slice("_ls", F.col("_x.s") + 1, F.col("_x.n")), "\n"),
        "start_line": F.col("start_line") + F.col("_x.s"),
        "end_line": F.when(last, F.col("end_line")).otherwise(F.col("start_line") + F.col("_x.s") + F.col("_x.n") - 1),
        "chunk_type": F.when(first, F.col("chunk_type")).otherwise("block"),
        "symbol_name": F.when(first, F.col("symbol_name")),
        "signature": F.when(first, F.col("signature")),
    }
    return p.select(*(out[c].alias(c) if c in out else F.col(c) for c in chunks.columns), "piece_no")


def embedding_text(rel_path: Column, with_path: bool = True) -> Column:
    """The text that is embedded for a chunk: a head of path, language and symbol, a blank line, the content; without a
    path, the type and the content. Uses the columns content, chunk_type, language and symbol_name."""
    plain = F.concat(F.col("chunk_type"), F.lit(": "), F.col("content"))
    if not with_path:
        return plain
    named = F.col("chunk_type").isin("function", "class", "method", "type") & (F.coalesce(F.col("symbol_name"), F.lit("")) != "")
    head = F.concat(
        F.lit("File: "), rel_path, F.lit("\n"),
        F.when(F.coalesce(F.col("language"), F.lit("")) != "", F.concat(F.lit("Language: "), F.col("language"), F.lit("\n"))).otherwise(""),
        F.when(named, F.concat(F.col("chunk_type"), F.lit(": "), F.col("symbol_name"), F.lit("\n"))).otherwise(""), F.lit("\n"), F.col("content"),
    )
    return F.when(F.coalesce(rel_path, F.lit("")) == "", plain).otherwise(head)


def token_windows(rows: DataFrame, id_cols: list[str], ids_col: str, context: int, first: int, last: int) -> DataFrame:
    """(ids, window_no, tokens): lists over ``context`` tokens as windows of context - 2 content tokens, each framed by the
    first and last id again; shorter lists as they are. ``ids_col`` includes the frame."""
    inner = F.slice(F.col(ids_col), 2, F.greatest(F.size(ids_col) - 2, F.lit(0)))
    step = context - 2
    d = rows.where(F.col(ids_col).isNotNull()).select(*id_cols, F.col(ids_col).alias("_a"), inner.alias("_i"))
    n = F.when(F.size("_a") <= context, 1).otherwise(F.ceil(F.size("_i") / step).cast("int"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("window_no"))
    cut = F.concat(F.array(F.lit(first)), F.slice("_i", F.col("window_no") * step + 1, F.lit(step)), F.array(F.lit(last)))
    return d.select(*id_cols, "window_no", F.when(F.size("_a") <= context, F.col("_a")).otherwise(cut).alias("tokens"))


def mean_pool(rows: DataFrame, key: str, vector_col: str) -> DataFrame:
    """(key, vector): the element-wise mean of each key's vectors, not normalised. Partial sums per element are combined
    before the shuffle, so that a key with very many vectors is no hot task. Null vectors don't count."""
    e = rows.where(F.col(vector_col).isNotNull()).select(F.col(key).alias("_k"), F.posexplode(vector_col).alias("_i", "_v"))
    m = e.groupBy("_k", "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"])
    return m.groupBy("_k").agg(v.alias("vector")).select(F.col("_k").alias(key), "vector")


# -- structure-aware chunkers -----------------------------------------------------------------------------------------

Piece = structure.Piece


def python_pieces(lines: list[str]) -> list[Piece] | None:
    """Functions, methods and classes by Python's own syntax tree; where the file does not parse, by its headers and
    indentation."""
    try:
        tree = ast.parse("\n".join(lines))
    except (SyntaxError, ValueError, RecursionError):
        return structure.pieces(lines, "python")
    out: list[Piece] = []

    def walk(node: ast.AST, parent: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("method" if parent else "function", x.lineno, x.end_lineno or x.lineno, x.name, parent))
                walk(x, parent)
            elif isinstance(x, ast.ClassDef):
                out.append(("class", x.lineno, x.end_lineno or x.lineno, x.name, parent))
                walk(x, x.name)
            else:
                walk(x, parent)

    walk(tree, None)
    return out


def markdown_pieces(lines: list[str]) -> list[Piece] | None:
    """A section for each heading, up to the next heading of the same or a higher level; fences hide headings. Sections
    are types without a name, so that they are no symbols."""
    heads, fence = [], ""
    for i, x in enumerate(lines, 1):
        m = re.match(r" {0,3}(```+|~~~+)", x)
        if m and (not fence or m[1].startswith(fence)):
            fence = "" if fence else m[1]
        m = None if fence else re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", x)
        if m:
            heads.append((i, len(m[1]), m[2]))
    out: list[Piece] = []
    for k, (at, level, title) in enumerate(heads):
        end = next((a - 1 for a, n, _ in heads[k + 1 :] if n <= level), len(lines))
        out.append(("type", at, end, None, None))
    return out or None


def bash_pieces(lines: list[str], most: int = BASH_LINES) -> list[Piece] | None:
    """Shell functions with an opening brace on their first line, outermost ones; one that does not close, or takes more
    than ``most`` lines, is skipped."""
    out: list[Piece] = []
    for p in structure.pieces(lines, "bash") or ():
        if p[2] - p[1] < most and not (out and p[1] <= out[-1][2]):
            out.append(p)
    return out or None


#: language -> chunker of lines; callers may add their own.
CHUNKERS: dict[str, Callable[[list[str]], list[Piece] | None]] = {x: lambda lines, x=x: structure.pieces(lines, x) for x in structure.LANGUAGES}
CHUNKERS |= {"python": python_pieces, "markdown": markdown_pieces, "bash": bash_pieces}


def enabled_languages(wanted: Sequence[str], chunkers: dict[str, Callable] | None = None) -> tuple[dict[str, Callable], list[str]]:
    """(chunkers of the wanted languages, names without one): an allow-list; an empty one allows all."""
    known = CHUNKERS if chunkers is None else chunkers
    if not wanted:
        return dict(known), []
    names = {w.strip().lower() for w in wanted} - {""}
    return {n: known[n] for n in sorted(names & known.keys())}, sorted(names - known.keys())


def _windows(data: str) -> list[tuple[str, int, int]]:
    b = data.encode()
    out = []
    for i in range(0, max(1, -(-(len(b) - OVERLAP) // (WINDOW - OVERLAP))) if b else 0):
        p0 = i * (WINDOW - OVERLAP)
        w = b[p0 : p0 + WINDOW]
        start = 1 + b.count(b"\n", 0, p0)
        out.append((w.decode("utf-8", "replace"), start, start + w.count(b"\n")))
    return out


def chunk_file(content: str, language: str | None) -> list[dict]:
    """All chunks of one file before oversized ones are cut: its pieces, then what they leave as module chunks; sliding
    windows where no chunker finds anything."""
    lines = content.split("\n")
    pieces = CHUNKERS[language](lines) if language in CHUNKERS else None
    if not pieces:
        return [{"content": c, "chunk_type": "block", "start_line": s, "end_line": e, "symbol_name": None, "signature": None, "parent_name": None} for c, s, e in _windows(content)]
    out, covered = [], bytearray(len(lines) + 2)
    for kind, s, e, name, parent in pieces:
        body = lines[s - 1 : e]
        out.append({"content": "\n".join(body), "chunk_type": kind, "start_line": s, "end_line": e, "symbol_name": name, "signature": body[0].strip(" \t\r\n"), "parent_name": parent})
        covered[s : e + 1] = b"\1" * (e + 1 - s)
    i = 1
    while i <= len(lines):
        if covered[i]:
            i += 1
            continue
        j = i
        while j < len(lines) and not covered[j + 1]:
            j += 1
        body = "\n".join(lines[i - 1 : j])
        if body.strip(" \t\n\r"):
            out.append({"content": body, "chunk_type": "module", "start_line": i, "end_line": j, "symbol_name": None, "signature": None, "parent_name": None})
        i = j + 1
    return out


def chunk_files(files: DataFrame, id_col: str = "file_id", text_col: str = "content", limit: int = MAX_CHUNK) -> DataFrame:
    """(id, language, idx, content, chunk_type, start_line, end_line, symbol_name, signature, parent_name) of each file.

    Python goes by its syntax tree, Markdown by headings, the languages of ``structure.LANGUAGES`` by their declarations (a
    lexical approximation of a syntax tree); other files, and those a chunker finds nothing in, by sliding windows. Oversized structural
    chunks are cut by ``pack_lines``. Null and empty contents have no chunks. ``idx`` is the position in the file.
    """
    kind = files.schema[id_col].dataType.simpleString()
    src = files.where(F.octet_length(text_col) > 0).select(F.col(id_col).alias("_id"), "language", F.col(text_col).alias("_t"))
    names = ["content", "chunk_type", "start_line", "end_line", "symbol_name", "signature", "parent_name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                row, idx, cols = [], [], [[] for _ in names]
                for r, (lang, t) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    for k, c in enumerate(chunk_file(t, lang)):
                        row.append(r)
                        idx.append(k)
                        for col, n in zip(cols, names):
                            col.append(c[n])
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(idx, pa.int32()), *(pa.array(c, t) for c, t in zip(cols, types))], [id_col, "language", "idx", *names])

    raw = spread(src).mapInArrow(run, f"`{id_col}` {kind}, language string, idx int, content string, chunk_type string, start_line int, end_line int, symbol_name string, signature string, parent_name string")
    structural = raw.where("chunk_type <> 'block'")
    return pack_lines(structural, limit).unionByName(raw.where("chunk_type = 'block'").withColumn("piece_no", F.lit(0)))


def symbols_of_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks that are symbols: functions, classes, methods and types with a name."""
    return chunks.where(F.col("chunk_type").isin("function", "class", "method", "type") & F.col("symbol_name").isNotNull())


def signatures(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("signature", text.signature_of(F.col("content")))
