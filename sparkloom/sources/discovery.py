"""Discovering files: directory scans, ignore rules, filters."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..streaming.folds import EXCLUDED_DIRS

# Files and extensions that discovery leaves out, and the size limit; the directories are the watcher's.
CONFIG_FILES = (".gitignore", ".gitmodules")
#: Files with ignore rules, and the index's own files; parameters, as an installation may name its own otherwise.
RULE_FILES = (".gitignore", ".indexignore")
OWN_FILES = (".indexignore", ".indexconfig.yaml")
BINARY_EXTENSIONS = tuple(
    ".pyc .pyo .class .o .obj .exe .dll .so .dylib .a .lib .jpg .jpeg .png .gif .ico .svg .bmp .tiff .webp .mp3 .mp4 .avi .mov .wav .flac .zip .tar .gz .rar .7z .bz2 "
    ".woff .woff2 .ttf .eot .pdf .doc .docx .xls .xlsx .db .sqlite .sqlite3 .wasm .map .lock .sum .log".split()
)
MAX_SIZE = 524_288


def _filesystem(root: str):
    """(file system, path) of a local path or a URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def scan(spark: SparkSession, root: str, exclude_dirs: Sequence[str] = ()) -> DataFrame:
    """(path, rel_path, length, modified) of all files below a directory, without excluded and hidden directories.

    Spark's own file sources leave out names that begin with a dot or an underscore, rule files and ``__init__.py`` among
    them; so the subtrees of the top level are walked in tasks, each pruned as it goes. ``root`` must be reachable from the
    executors. A directory that cannot be read is left out.
    """
    from pyarrow import fs as pafs

    root = root.rstrip("/")
    fs, base = _filesystem(root)
    skip = frozenset((*EXCLUDED_DIRS, *exclude_dirs))
    prune = lambda name: name in skip or name.startswith(".")
    top = fs.get_file_info(pafs.FileSelector(base, recursive=False))
    todo = [(x.path,) for x in top if x.type == pafs.FileType.Directory and not prune(x.base_name)]
    here = [(x.path, x.size, x.mtime) for x in top if x.type == pafs.FileType.File]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = _filesystem(root)
        for pdf in batches:
            stack = list(pdf["path"])
            while stack:
                rows = []
                try:
                    found = own.get_file_info(pafs.FileSelector(stack.pop(), recursive=False))
                except OSError:
                    continue
                for x in found:
                    if x.type == pafs.FileType.Directory:
                        if not prune(x.base_name):
                            stack.append(x.path)
                    elif x.type == pafs.FileType.File:
                        rows.append((x.path, x.size, x.mtime))
                yield pd.DataFrame(rows, columns=["path", "length", "modified"])

    schema = "path string, length bigint, modified timestamp"
    out = spark.createDataFrame(here, schema)
    if todo:
        out = out.unionByName(spark.createDataFrame(todo, "path string").repartition(len(todo)).mapInPandas(walk, schema))
    return out.withColumn("rel_path", text.relative_path(F.col("path"), F.lit(base)))


def read_content(files: DataFrame, root: str) -> DataFrame:
    """The files with their bytes; one that is gone or can't be read has a null content."""

    @F.pandas_udf("binary")
    def bytes_of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fs, _ = _filesystem(root)
        for s in it:
            out = []
            for p in s:
                try:
                    with fs.open_input_stream(p) as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return files.withColumn("content", bytes_of("path"))


def not_excluded(rel: Column, exclude_dirs: Sequence[str] = ()) -> Column:
    """No directory of the path is excluded or hidden."""
    names = [*EXCLUDED_DIRS, *exclude_dirs]
    dirs = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    return ~F.exists(dirs, lambda x: x.isin(*names) | F.startswith(x, F.lit(".")))


def keepable(files: DataFrame, exclude_dirs: Sequence[str] = (), max_size: int = MAX_SIZE, own_files: Sequence[str] = OWN_FILES) -> DataFrame:
    """Files by directory, configuration name, extension and size (1 to ``max_size`` bytes)."""
    rel = F.col("rel_path")
    return files.where(not_excluded(rel, exclude_dirs) & ~text.base_name(rel).isin(*CONFIG_FILES, *own_files) & ~text.extension(rel).isin(*BINARY_EXTENSIONS) & F.col("length").between(1, max_size))


def pattern_regex(pattern: str) -> tuple[re.Pattern, bool] | None:
    """(regular expression over paths relative to the rule's directory, negated) of one line of an ignore file."""
    p = pattern.rstrip("\r\n")
    p = re.sub(r"(?<!\\)\s+$", "", p)
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p[1:] if negated else p
    p = p[1:] if p.startswith("\\") and p[1:2] in "#!" else p
    below = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if p.startswith("/**", i) and i + 3 == len(p):
            out += "/.*"
            i += 3
            continue
        if p.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (j := p.find("]", i + 2)) > 0:
            out += "[" + p[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]"
            i = j
        elif c == "\\" and i + 1 < len(p):
            i += 1
            out += re.escape(p[i])
        else:
            out += re.escape(c)
        i += 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + ("/.*" if below else "(?:/.*)?") + r"\Z", re.S), negated


@functools.lru_cache(maxsize=10_000)
def _compiled(rules: tuple[str, ...]) -> list[tuple[re.Pattern, bool]]:
    return [x for x in map(pattern_regex, rules) if x]


def ignored(rel: str, rules: tuple[str, ...]) -> bool:
    """Whether one ignore file's rules leave a path out; the last rule that matches decides."""
    out = False
    for r, negated in _compiled(rules):
        if r.match(rel):
            out = not negated
    return out


def rules_of(files: DataFrame, text_col: str = "text", rule_files: Sequence[str] = RULE_FILES) -> DataFrame:
    """(dir, rules): the lines of each ignore file, by the directory it lies in (empty for the root)."""
    rel = F.col("rel_path")
    d = files.where(text.base_name(rel).isin(*rule_files))
    return d.select(F.regexp_replace(rel, r"/?[^/]*$", "").alias("dir"), F.split(text_col, "\n").alias("rules"))


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no ignore file in a directory above them leaves out. Each file is joined by equality with the rules of its
    directories; a rule's paths are relative to its directory, and ignore files do not negate each other."""
    rel = F.col("rel_path")
    n = F.size(F.split(rel, "/"))
    dirs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(F.split(rel, "/"), 1, i), "/"))
    near = files.select("rel_path", F.explode(dirs).alias("dir")).join(rules, "dir")

    @F.pandas_udf("boolean")
    def hit(rel: pd.Series, dirs: pd.Series, rules: pd.Series) -> pd.Series:
        return pd.Series([ignored(p[len(d) + 1 :] if d else p, tuple(r)) for p, d, r in zip(rel, dirs, rules)], dtype=bool)

    out = near.where(hit("rel_path", "dir", "rules")).select("rel_path").distinct()
    return files.join(out, "rel_path", "left_anti")


def submodule_paths(gitmodules: Column) -> Column:
    """The paths that a .gitmodules text lists, as rules."""
    return F.transform(F.regexp_extract_all(gitmodules, F.lit(r"(?m)^\s*path\s*=\s*(.+?)\s*$"), F.lit(1)), lambda p: F.concat(p, F.lit("/")))


# Signatures of content that is no text (offset 0 unless given), after the public MIME sniffing standard.
_SIGNATURES = (b"%PDF-", b"%!PS-Adobe-", b"\x00\x00\x01\x00", b"\x00\x00\x02\x00", b"BM", b"GIF87a", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b".snd", b"OggS\x00", b"MThd\x00\x00\x00\x06", b"ID3", b"\x1aE\xdf\xa3", b"\x00\x01\x00\x00", b"OTTO", b"ttcf", b"wOFF", b"wOF2", b"\x1f\x8b\x08", b"PK\x03\x04", b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00", b"\x00asm")
_CONTROL = frozenset([*range(0x00, 0x09), 0x0B, *range(0x0E, 0x1B), *range(0x1C, 0x20)])


def is_text(head: bytes) -> bool:
    """Whether the first 512 bytes look like text."""
    h = bytes(head[:512])
    if h[:2] in (b"\xfe\xff", b"\xff\xfe") or h[:3] == b"\xef\xbb\xbf":
        return True
    if any(h.startswith(s) for s in _SIGNATURES):
        return False
    if h[:4] == b"RIFF" and h[8:12] in (b"WEBP", b"WAVE", b"AVI ") or h[4:8] == b"ftyp":
        return False
    return not any(b in _CONTROL for b in h)


def text_only(files: DataFrame, content: str = "content") -> DataFrame:
    """Files whose first 512 bytes look like text; only those bytes leave the JVM."""

    @F.pandas_udf("boolean")
    def sniffed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda b: b is not None and is_text(b)).astype(bool)

    return files.where(sniffed(F.substring(content, 1, 512)))


def discover(spark: SparkSession, root: str, exclude_dirs: Sequence[str] = (), max_size: int = MAX_SIZE, rule_files: Sequence[str] = RULE_FILES, own_files: Sequence[str] = OWN_FILES, submodules: bool = False) -> DataFrame:
    """(path, rel_path, content, content_hash, language, size): the text files below a directory that no rule leaves out,
    in no order; language as the client detects it. With ``submodules`` the directories that .gitmodules lists are left
    out too."""
    found = scan(spark, root, exclude_dirs)
    is_rule = text.base_name(F.col("rel_path")).isin(*rule_files)
    rules = rules_of(read_content(found.where(is_rule), root).withColumn("text", F.decode("content", "utf-8")), rule_files=rule_files)
    modules = read_content(found.where(F.col("rel_path") == ".gitmodules"), root).select(F.lit("").alias("dir"), submodule_paths(F.decode("content", "utf-8")).alias("rules"))
    rules = rules.unionByName(modules) if submodules else rules
    kept = text_only(read_content(not_ignored(keepable(found, exclude_dirs, max_size, own_files), rules), root))
    return kept.select("path", "rel_path", F.decode("content", "utf-8").alias("content"), F.sha2("content", 256).alias("content_hash"), text.detect_language_client(F.col("path")).alias("language"), F.col("length").alias("size"))
