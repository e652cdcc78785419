"""Telling hand-written source files from generated, minified, vendored ones and from data saved as code."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, spread

#: Tokens of a fingerprint, and fingerprints of a window of which winnowing keeps the least.
K = 30
WINDOW = 30
#: A file is a vendored copy if this part of its fingerprints occurs in at least so many projects.
RECURRING = 0.6
PROJECTS = 2
#: A directory name is one of third-party code if this part of the files below directories of that name are copies, where
#: a name that conventions reserve for such code begins with so many imagined copies and any other with as many files that
#: are none. Copies found by fingerprints outweigh the convention as soon as a name has more files than that.
COPIED_DIR = 0.4
PRIOR = 8

# What tools write at the head of the files they produce, in several languages.
_GENERATED = re.compile(
    r"(?i)\bcode generated\b|(?<!un)@(?:auto-?)?generated\b|<auto-?generated|\bauto-?generated (?:by|from|with|using|on|code|file)\b|\b(?:this file (?:is|was|has been) )?(?:auto(?:matically|-)? ?|machine[- ])generated\b(?! (?:method|function|constructor|catch|stub|class) ?(?:stub|block)?)"
    r"|\bgenerated (?:by|from|with|using|automatically)\b|\bmachine-written\b|\b(?:do not|don'?t|never) (?:edit|modify|change|touch)\b(?:.{0,30}\b(?:by hand|manually|file)\b|\W*$|[.!]? )|\b(?:changes|edits|modifications)\b.{0,30}\bwill be (?:lost|overwritten|discarded)\b"
    r"|\bedit the \w+ instead\b|\bproduced by\b.{0,40}\b(?:do not|don'?t)\b"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht (?:bearbeiten|ändern|editieren|von hand)\b|\bfichier (?:produit|généré)\b|\bgénéré (?:par|automatiquement)\b|\bne pas (?:modifier|éditer)\b"
    r"|\b(?:archivo |fichero )?generado (?:por|automáticamente)\b|\bno (?:editar|modificar)\b|\bgerado (?:por|automaticamente)\b|\bnão (?:editar|edite|modificar)\b|\bgenerato (?:da|automaticamente)\b|\bnon modificare\b"
    r"|自動生成|編集しない|自动生成|请勿(?:编辑|修改)|сгенерирован|не редактировать"
)
_NOT_GENERATED = re.compile(r"(?i)\b(?:originally|formerly|initially|once|first|previously) (?:auto-?)?generated\b|\b(?:maintained|edited|written|kept) by hand\b|\bunlike the\b|\b(?:writes|produces|emits|creates|generates|checks|reads|parses) (?:the )?(?:files|code|output)\b|\bnot (?:auto(?:matically|-)? ?|machine[- ])?generated\b|\bhand[- ]?written\b|\bno longer generated\b|\bused to be generated\b|\bauto-?generated (?:method|function|constructor|catch)")
# What third parties' files say of themselves.
_UPSTREAM = re.compile(r"(?i)\bbundled copy of\b|\bupstream release\b|\bupstream authors\b|\bvendored (?:from|copy|by)\b|\bcopied (?:verbatim )?from upstream\b|\bimported from upstream\b|\bthird[- ]party (?:code|library|copy)\b")
_BANNER = re.compile(r"^\s*/\*![^*]{0,80}\bv?\d+\.\d+")
# Directory names that package managers and conventions reserve for third-party code.
CONVENTIONAL = ("vendor", "third_party", "thirdparty", "third-party", "node_modules", "site-packages", "dist-packages", "_vendor", "_vendored", "external", "externals", "Pods", "bower_components", "jspm_packages", "deps", "Carthage", "Godeps")
_LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|uv\.lock|Pipfile\.lock|Cargo\.lock|Gemfile\.lock|composer\.lock|go\.sum|packages\.lock\.json|mix\.lock|Podfile\.lock|pubspec\.lock|\.terraform\.lock\.hcl|bun\.lock|flake\.lock|gradle\.lockfile)$")
_LOCK_TEXT = re.compile(r"\"lockfileVersion\"\s*:|^lockfileVersion\s*:|^# yarn lockfile|^\[\[package\]\]|^[\w.\-/]+ v[\w.\-+]+(?:/go\.mod)? h1:|\"_meta\"\s*:\s*\{\s*\"hash\"|\"content-hash\"\s*:|^# This file is maintained automatically by", re.M)
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|<!--|--|;|\"\"\"|'''|%)")
_PREAMBLE = re.compile(r"^\s*(?:#!|<\?|package\s+[\w.]+;?\s*$|set\s+-|[\"']use strict)")
_DATA_LINE = re.compile(r"^[\s\[\](){},;]*(?:(?:b?\"[^\"]*\"|'[^']*'|[-+]?(?:0x[0-9a-fA-F]+|\d[\d._]*(?:[eE][-+]?\d+)?)[fFLlu]?|[A-Za-z0-9+/=]{40,}|null|None|true|false)[\s\[\](){},;:]*)+$")
_NUMBERED = re.compile(r"\b([A-Za-z]\w*?)_(\d{3})\b\s*(?:\(|=|\{)")
_TOOL_NAME = re.compile(r"(?:\.pb\.\w+|_pb2(?:_grpc)?\.py|_pb\.\w+|\.g\.\w+|[._]generated\.\w+|\.gen\.\w+|OuterClass\.java|_completion\.\w+|\.designer\.\w+|_string\.go|\.pb\.h)$")
_BUNDLE = re.compile(r"__webpack_require__|\bwebpackBootstrap\b|\(this\s*&&\s*this\.__importDefault\)|^//# sourceMappingURL=", re.M)
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|[^\s\w]")
_WHOLE_COMMENT = re.compile(r"(?m)^[ \t]*(?://|#|\*|/\*).*$")
_TEXT = frozenset((".md", ".rst", ".txt", ".adoc"))
_PLAIN_DATA = frozenset((".json", ".yaml", ".yml", ".csv", ".tsv", ".xml", ".toml", ".ini", ".env", ".tf", ".hcl", ".properties"))


class _Codes(dict):
    """lexeme -> number, kept for the lexemes of one task up to a bound."""

    def __missing__(self, t: str) -> int:
        v = zlib.crc32(t.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFF
        if len(self) > 300_000:
            self.clear()
        self[t] = v
        return v


def fingerprints(text: str, codes: dict, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Winnowed hashes of the runs of k tokens of a text without its comment lines and white space. A text of fewer than k
    tokens has none: so little may be the same in two places by chance. Sorted, distinct, signed 64 bits."""
    h = np.fromiter(map(codes.__getitem__, _TOKEN.findall(_WHOLE_COMMENT.sub("", text))), np.uint64)
    n = k
    if len(h) < n:
        return np.zeros(0, np.int64)
    x, w, have, out, done = h, 1, np.uint64(0x9E3779B97F4A7C15), None, 0
    rest = n
    while rest:  # hash of n codes by doubling
        if rest & 1:
            out = x if out is None else x[: len(x) - done] * _power(done) + out[w : w + len(x) - done] if done else x
            done += w
        rest >>= 1
        if rest:
            x = x[: len(x) - w] * _power(w) + x[w:]
            w *= 2
    out = out[: len(h) - n + 1]
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    out = out ^ (out >> np.uint64(29))
    m = min(window, len(out))
    step, y = 1, out
    while 2 * step <= m:
        y = np.minimum(y[: len(y) - step], y[step:])
        step *= 2
    if step < m:
        y = np.minimum(y[: len(y) - (m - step)], y[m - step :])
    return np.unique(y).view(np.int64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))


def _head(lines: list[str]) -> str:
    """The comments before the first line of code."""
    out, block = [], False
    for x in lines:
        s = x.strip()
        if not s:
            continue
        if block:
            out.append(s)
            block = "*/" not in s
        elif _PREAMBLE.match(s):
            continue
        elif _COMMENT.match(s):
            out.append(s)
            block = s.startswith("/*") and "*/" not in s
        else:
            break
    return "\n".join(out)


def _tail(lines: list[str]) -> str:
    """The comments after the last line of code."""
    out: list[str] = []
    block: list[str] | None = None  # the lines of a block comment whose beginning is not reached
    for x in reversed(lines):
        s = x.strip()
        if not s:
            continue
        if block is not None:
            if "*/" in s or "/*" in s and not s.startswith(("/*", "*")):
                break  # the block follows code on its line, or is none
            block.append(s)
            if s.startswith("/*"):
                out += block
                block = None
        elif s.endswith("*/") and not s.startswith("/*"):
            if "/*" in s and not s.startswith("*"):
                break
            block = [s]
        elif s.endswith("*/") or s.startswith(("//", "#", "--", ";", "<!--")):
            out.append(s)
        else:
            break
    return "\n".join(out)


def reason(path: str, text: str) -> str | None:
    """Why a file is not hand-written, from its own name and content: lock, generated, upstream, minified or data."""
    base = path.rsplit("/", 1)[-1]
    ext = base[base.rfind(".") :].lower() if "." in base else ""
    lines = text.split("\n")
    if _LOCK_NAME.search(path) or _LOCK_TEXT.search(text):
        return "lock"
    if ext in _TEXT:
        return None
    head = _head(lines) + "\n" + _tail(lines)
    if head != "\n":
        if any(_GENERATED.search(x) and not _NOT_GENERATED.search(x) for x in head.split("\n")):
            return "generated"
        if _UPSTREAM.search(head):
            return "upstream"
    numbered = {m[2] for m in _NUMBERED.finditer(text)} if "_00" in text else ()
    if len(numbered) >= (4 if _TOOL_NAME.search(base) else 8):
        return "generated"
    if ext not in _PLAIN_DATA:
        if max(map(len, lines)) > 250:
            bare = _STRING.sub('""', text)
            long = sum(len(x) for x in bare.split("\n") if len(x) > 200 and x.count(" ") < 0.2 * len(x))
            if long >= 0.5 * len(bare):
                return "minified"
        if _BANNER.match(text) and _BUNDLE.search(text) or "__webpack_require__" in text and "webpackBootstrap" in text:
            return "minified"
        body = [x for x in lines if x.strip()]
        if len(body) >= 12:
            total = sum(map(len, body))
            if sum(len(x) for x in body if x.lstrip()[:1] in _DATA_START and _DATA_LINE.match(x)) >= 0.8 * total:
                return "data"
        if len(text) >= _DATA_SIZE and _literal_share(_PEM.sub("", _WHOLE_COMMENT.sub("", text))) >= 0.8:
            return "data"
    return None


#: Characters from which a text is judged by its share of literals, however few its lines.
_DATA_SIZE = 1000
# keys and certificates within a script are no table
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----[^-]*+-----END [A-Z0-9 ]+-----")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`|(?<![\w.])(?:0x[0-9a-fA-F]++|\d[\d._]*+(?:[eE][-+]?\d++)?)[fFLlu]?(?!\w)|(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{40,}+")


def _literal_share(text: str) -> float:
    """The part that literals have of a text, without white space between them and without brackets, commas, colons and
    signs. A long string that reads as text (a query, a message) is none of them."""
    n = 0
    spaces = sum(map(text.count, " \t\r\n"))
    for m in _LITERAL.finditer(text):
        v = m[0]
        inner = sum(map(v.count, " \t\r\n"))
        spaces -= inner
        if len(v) <= 200 or inner <= 0.04 * len(v) or sum(map(str.isalpha, v)) <= 0.5 * len(v):
            n += len(v)
    marks = sum(map(_STRING.sub("", text).count, "[](){},;:-+"))
    return n / max(1, len(text) - spaces - marks)


_DATA_START = frozenset("\"'-+0123456789[({])},;ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz/=")


def not_handwritten(files: DataFrame, k: int = K, window: int = WINDOW, recurring: float = RECURRING, projects: int = PROJECTS, copied_dir: float = COPIED_DIR, prior: int = PRIOR) -> DataFrame:
    """(file_id, reason): files written by a tool, minified or bundled, third-party copies, or data saved as code.

    Third-party copies are found by winnowing. The token stream without comments and white space gives fingerprints; those
    that occur in at least ``projects`` projects are recurring, and a file whose fingerprints recur to the part
    ``recurring`` is a ``copy``. What copies are found also tells which directories hold such code: of every directory name
    the share of copies among the files below it is counted over the corpus, with ``prior`` imagined copies for a name
    that conventions reserve and as many imagined originals for any other; files below a name with a share of at least
    ``copied_dir`` are third-party too (``directory``), though nobody else has a copy of them here. A convention thus
    decides only until the corpus has spoken. The owners' exclude patterns are hints only and decide nothing.

    Lock files, heads and ends that say a tool (``generated``) or a third party (``upstream``) wrote the file, ``minified``
    text and tables of literals (``data``) are seen in the file itself. A file with several reasons has the first of:
    copy, lock, generated, minified, data, upstream, directory. Fingerprints and names of any number of files are counted
    with map-side combination and never gathered.

    Null or blank content gives no row; a null path counts as an empty one, rows with a null project or file_id belong to
    one unknown project or file. Repeated payloads of a file count once in the result. An empty input gives an empty
    result; extra columns are ignored.
    """
    src = files.where(F.col("content").isNotNull() & F.col("content").rlike(r"\S")).select("file_id", "project_path", F.coalesce("path", F.lit("")).alias("path"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        with np.errstate(over="ignore"):
            for b in batches:
                why, fps = [], []
                for path, text in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                    why.append(reason(path, text))
                    fps.append(fingerprints(text, codes, k, window))
                off = np.cumsum([0, *map(len, fps)]).astype(np.int32)
                values = pa.array(np.concatenate(fps) if fps else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("project_path"), b.column("path"), pa.array(why, pa.string()), pa.ListArray.from_arrays(pa.array(off), values)], ["file_id", "project_path", "path", "reason", "fps"])

    checkpoint_dir(files.sparkSession)
    seen = spread(src).mapInArrow(run, "file_id bigint, project_path string, path string, reason string, fps array<bigint>").checkpoint()
    project = F.coalesce("project_path", F.lit(""))
    prints = seen.select("file_id", project.alias("project_path"), F.explode("fps").alias("fp"))
    # least and greatest project of a fingerprint tell whether it has two; more are counted
    if projects == 2:
        common = prints.groupBy("fp").agg(F.min("project_path").alias("a"), F.max("project_path").alias("z")).where("a <> z").select("fp")
    else:
        common = prints.select("fp", "project_path").distinct().groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") >= projects).select("fp")
    hits = prints.join(common, "fp").groupBy("file_id").agg(F.count("*").alias("hits"))
    sizes = seen.groupBy("file_id").agg(F.sum(F.size("fps")).alias("all"))
    copies = hits.join(sizes, "file_id").where(F.col("hits") >= recurring * F.col("all")).select("file_id").checkpoint()
    named = seen.select("file_id", F.explode(directory_names(F.col("path"), project)).alias("dir")).distinct()
    rate = (F.count("_c") + F.when(F.col("dir").isin(*CONVENTIONAL), prior).otherwise(0)) / (F.count("*") + prior)
    marked = named.join(copies.withColumn("_c", F.lit(1)), "file_id", "left")
    third = marked.groupBy("dir").agg(rate.alias("rate")).where(F.col("rate") >= copied_dir).select("dir")
    below = named.join(third, "dir").select("file_id", F.lit("directory").alias("reason"))
    own = seen.where("reason is not null").select("file_id", "reason")
    every = own.unionByName(copies.withColumn("reason", F.lit("copy"))).unionByName(below)
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    return every.groupBy("file_id").agg(F.min_by("reason", rank).alias("reason"))


REASONS = ("copy", "lock", "generated", "minified", "data", "upstream", "directory")


def directory_names(path: Column, project: Column) -> Column:
    """The distinct names of the directories between a project's root and a file."""
    below = F.when(F.startswith(path, F.concat(project, F.lit("/"))), F.substr(path, F.length(project) + 2)).otherwise(path)
    parts = F.split(below, "/")
    return F.array_distinct(F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x: x != ""))
