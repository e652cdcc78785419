"""Symbols, definitions, references and files by name."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..session import spread

_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*")

# Identifiers that are no references worth keeping.
SKIPPED_NAMES = frozenset(
    "self cls None True False print len range type list dict set tuple int str float bool bytes object Exception isinstance hasattr getattr setattr "
    "undefined null true false console window document Array Object String Number Boolean Promise Map Set "
    "nil fmt err ctx Ok Err Some this super void".split()
)


def _lowest_level(rows: DataFrame, levels: Sequence[Column]) -> DataFrame:
    """The rows of the first level that any row reaches: one scan and one aggregate instead of a query per level."""
    level = None
    for i, c in enumerate(levels, 1):
        level = F.when(c, i) if level is None else level.when(c, i)
    leveled = rows.withColumn("_level", level).where("_level is not null")
    best = leveled.agg(F.min("_level").alias("_best"))
    return leveled.join(F.broadcast(best), F.col("_level") == F.col("_best")).drop("_level", "_best")  # one row is broadcast


def _narrow(symbols: DataFrame, project: str | None, kinds: Sequence[str], file: str | None) -> DataFrame:
    s = symbols
    if project is not None:
        s = s.where(F.col("project_path") == project)
    if kinds:
        s = s.where(F.col("kind").isin(*kinds))
    if file:
        s = s.where(F.col("file_path") == file)
    return s


def search_symbols(symbols: DataFrame, query: str, project: str | None = None, kinds: Sequence[str] = (), limit: int | None = 20) -> DataFrame:
    """Symbols whose name is the query, else begins with it, else contains it; ASCII case does not count, % and _ in the
    query are wildcards. Ordered by name, file and line."""
    s = _narrow(symbols, project, kinds, None)
    out = _lowest_level(s, [text.like_folded(F.col("name"), p) for p in (query, f"{query}%", f"%{query}%")])
    return out.orderBy("name", "file_path", "line").limit(scores.limit_of(limit, 20))


def definitions(symbols: DataFrame, name: str, project: str | None = None, kinds: Sequence[str] = (), file: str | None = None, limit: int | None = 10) -> DataFrame:
    """Symbols of exactly this name, else of this name without regard to ASCII case (wildcards live)."""
    s = _narrow(symbols, project, kinds, file)
    out = _lowest_level(s, [F.col("name") == name, text.like_folded(F.col("name"), name)])
    return out.orderBy("name", "file_path", "line").limit(scores.limit_of(limit, 10))


def references(refs: DataFrame, name: str, file: str | None = None, limit: int | None = 50) -> DataFrame:
    """Uses of a name as hits: a reference is one line with no content."""
    r = refs.where(F.col("name") == name)
    if file:
        r = r.where(F.col("file_path") == file)
    r = r.orderBy("file_path", "line", "col").limit(scores.limit_of(limit, 50))
    return r.select("file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit("").alias("content"), F.lit("reference").alias("chunk_type"), F.col("name").alias("symbol_name"), "language", "col")


def files_like(files: DataFrame, query: str, project: str | None = None, limit: int | None = 20, path_col: str = "path") -> DataFrame:
    """Paths that contain the query, with the language their name tells."""
    f = files.where(F.col("project_path") == project) if project is not None else files
    f = f.where(text.like_folded(F.col(path_col), f"%{query}%")).select(F.col(path_col).alias("file_path")).distinct()
    return f.orderBy("file_path").limit(scores.limit_of(limit, 20)).withColumn("language", text.detect_language(F.col("file_path")))


def project_symbols(symbols: DataFrame, project: str) -> DataFrame:
    return symbols.where(F.col("project_path") == project).orderBy("kind", "name", "file_path", "line")


def first_symbols(symbols: DataFrame, most: int = 20) -> DataFrame:
    """The first symbols of each project, in order of file, line and name (a project's storage order, made definite)."""
    w = Window.partitionBy("project_path").orderBy("file_path", "line", "name", "symbol_id")
    return symbols.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def newest_first(rows: DataFrame, at: str, key: str, limit: int | None = None) -> DataFrame:
    """The rows by time, the newest first, ties by key; as a list shows projects, keys and sessions."""
    out = rows.orderBy(F.desc(at), F.asc(key))
    return out.limit(limit) if limit else out


def names_by_language(symbols: DataFrame) -> DataFrame:
    """(language, symbols): the number of named symbols of each language; a null or empty one counts as (unknown)."""
    lang = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("(unknown)"))
    return symbols.where(F.col("name").isNotNull() & (F.col("name") != "")).groupBy(lang.alias("language")).agg(F.count("*").alias("symbols"))


def extract_references(files: DataFrame, text_col: str = "content", path_col: str = "path") -> DataFrame:
    """(name, file_path, line, col, language): identifiers of each line, with 1-based lines and 0-based byte columns.

    Names of less than two bytes and skipped words are left out; a file is to come once, as repeated rows repeat their
    references. A lexical approximation of the identifiers of a syntax tree: texts inside strings and comments count too.
    """
    src = files.where(F.col(text_col).isNotNull()).select(F.col(path_col).alias("file_path"), "language", F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names, lines, cols = [], [], [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                for n, line in enumerate(t.split("\n"), 1):
                    found = _IDENTIFIER.finditer(line)
                    plain = line.isascii()
                    for m in found:
                        name = m[0]
                        if len(name) > 1 and name not in SKIPPED_NAMES:
                            rows.append(i)
                            names.append(name)
                            lines.append(n)
                            cols.append(m.start() if plain else len(line[: m.start()].encode()))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), b.column("file_path").take(take), pa.array(lines, pa.int32()), pa.array(cols, pa.int32()), b.column("language").take(take)], ["name", "file_path", "line", "col", "language"])

    return spread(src).mapInArrow(run, "name string, file_path string, line int, col int, language string")


def without_definitions(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References that are not the own name of a definition on the same line."""
    s = symbols.select("file_path", "name", "line").distinct()
    return refs.join(s, ["file_path", "name", "line"], "left_anti")


def latest_symbols(symbols: DataFrame) -> DataFrame:
    """Of symbols indexed again, the latest row per (file_id, name, kind, line); ties by id."""
    w = Window.partitionBy("file_id", "name", "kind", "line").orderBy(F.desc("indexed_at"), F.desc("symbol_id"))
    return symbols.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
