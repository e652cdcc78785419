"""Functions paired with their documentation."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize

_HASH = frozenset(("python", "bash", "ruby", "perl", "r", "yaml", "hcl", "make", "dockerfile"))
_WORD = re.compile(r"[^\W\d_]+")

# The beginnings of comments that only speak to a tool.
_DIRECTIVE = re.compile(
    r"(?i)^[\W_]*(?:(?:noqa|nolint|nosec|nosonar|noinspection|no-?check|pylint|pyright|mypy|flake8|yapf|eslint|tslint|jshint|jslint|stylelint|istanbul|webpack\w*"
    r"|ts-(?:ignore|nocheck|expect-error|check)|golangci|checkstyle|spotbugs|findbugs|sonar\w*|shellcheck|shfmt|spell-?checker|cspell|codespell|skipcq|endregion)\b"
    r"|(?:type:\s*ignore|prettier-ignore|biome-ignore|@ts-\w+|@formatter|@suppress\w*|go:\w+|\+build\b|-\*-|export_test|c8 ignore|v8 ignore)"
    r"|(?:ruff|fmt|isort|black|pragma|coverage|bandit|revive|gosec|lint|pmd|errorprone|region|editorconfig|vim|vi|emacs|language|deepsource|codacy|sourcery|snyk|semgrep)\s*(?:[:=]|-(?:ignore|disable|enable|off)|$|no cover|once))"
)
# Texts that stand where documentation should, or promise it.
_PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:(?:todo|fixme|tbd|tba|tbc|xxx|hack|wip|n/?a|none|nil|null|fill ?(?:me|in|this)|placeholder|lorem ipsum|foo|bar|test|stub|docstring|docs?|documentation|description|summary|comment|missing|empty|undocumented|untitled|no (?:docs?|documentation|description|comment)\w*)\b\W*$"
    r"|(?:todo|fixme|tbd|xxx|hack)\b"
    r"|auto[- ]?generated\b.*\b(?:stub|method|function|constructor|catch block|comment|docstring|documentation)\b"
    r"|(?:(?:please|must|should|to)\s+)*(?:add|write|insert|fill in|provide|complete|improve|document|describe)\b.{0,60}\b(?:later|soon|here|docs?|docstring|documentation|description|comment|this|me|it|function|method)\W*$"
    r"|(?:docs?|documentation|description|docstring|comments?)\b.{0,40}\b(?:here|follows?|to follow|pending|later|soon|missing|needed|required|coming|goes|go|to come|to be \w+|will \w+.*)\W*$"
    r"|(?:will|to|should|must|needs? to) be (?:documented|described|written|added|done|filled)\b.*"
    r"|(?:needs?|lacks?|missing|requires?|awaiting|pending)\b.{0,20}\b(?:docs?|documentation|description|docstring|comments?)\W*$"
    r"|(?:your|insert|enter)\b.{0,30}\b(?:here|text)\W*$|coming soon\W*$|(?:see|to) (?:be )?(?:later|tbd)\W*$|work in progress\W*$)"
)
_CODE = (
    re.compile(r"^[\w.$\[\]'\"<>*&, ()]*?[\w\])]\s*(?::=|\+=|-=|\*=|/=|\|\|=|(?<![=!<>])=(?![=>]))\s*\S"),
    re.compile(r"^(?:await\s+|new\s+|go\s+|defer\s+|\$\()?[\w.$]+(?:<[\w, ]*>)?\(.*\)\s*[;{:]?$"),
    re.compile(r"^(?:return|if|elif|else|for|while|switch|case|try|catch|except|finally|with|raise|throw|assert|import|from|const|let|var|def|func|function|class|public|private|protected|static|yield|await|async|print|echo|local|export|readonly|package|type|struct|fi|done|do|esac|break|continue|pass)\b.*(?:[(){}\[\];]|=|:$|:=|->|=>)"),
    re.compile(r".*[;{}]$"),
    re.compile(r"^[\])}(\[{;,]+$"),
    re.compile(r"^(?:return|break|continue|pass|fi|done|esac|else:?|try:?|finally:?)\s*;?$"),
    re.compile(r"^return\s+(?:-?\d+|[\w.]+|[\"'].*[\"'])\s*;?$"),
)
_TAG = re.compile(r"^(?:@|\\)(\w+)\b(.*)$")
_REST_TAG = re.compile(r"^:(\w+)([^:]*):(.*)$")
_SECTION = re.compile(r"(?i)^(?:args?|arguments?|params?|parameters?|returns?|yields?|raises?|throws?|exceptions?|attributes?|keyword args|notes?|examples?|see also|warnings?|other parameters)\s*:?\s*$")
_NAMED = frozenset("param params arg argument parameter throws exception raises raise throw property prop typeparam template tparam keyword var ivar cvar".split())
_TYPED = frozenset("type rtype vartype".split())


@functools.lru_cache(maxsize=100_000)
def _name_words(name: str) -> frozenset[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", name))
    return frozenset(w.lower() for w in _WORD.findall(spaced))


def _described(line: str) -> str:
    """What a line says beside documentation tags; empty if it has a tag without a description."""
    m = _TAG.match(line)
    if m:
        tag, rest = m[1].lower(), m[2].strip()
        if tag in ("inheritdoc", "override", "see", "since", "author", "version", "deprecated", "internal", "private", "public", "protected", "static", "async", "api", "hidden", "ignore", "link", "category", "module", "group"):
            return "" if tag in ("inheritdoc", "override", "internal", "private", "public", "protected", "static", "async", "api", "hidden", "ignore", "see", "link", "since", "author", "version", "category", "module", "group") else rest
        rest = re.sub(r"^\{[^}]*\}", "", rest).strip()
        if tag in _NAMED:
            rest = re.sub(r"^(?:\[[^\]]*\]|<?[\w.$*]+>?)", "", rest).strip()
        return rest.strip(" -:.,")
    m = _REST_TAG.match(line)
    if m:
        return "" if m[1].lower() in _TYPED else m[3].strip(" -:.,")
    return line


def meaningful(doc: str, name: str) -> bool:
    """Whether a cleaned documentation says something: not only the name's words, a placeholder or a promise, tool
    directives, separators, commented-out code, or tags without a description."""
    own = _name_words(name) | {"the", "function", "method", "a", "an"}
    section = ""
    said: set[str] = set()
    for raw in doc.split("\n"):
        line = raw.strip()
        if not line or not any(c.isalnum() for c in line):
            continue
        if _DIRECTIVE.match(line):
            continue
        if _SECTION.match(line):
            section = line
            continue
        text = _described(line)
        if text is line and section:
            m = re.match(r"^\*{0,2}[\w.]+(?:\s*\([^)]*\))?\s*(?::\s*(.*))?$", line)
            if m and (m[1] is None or ":" in line):
                text = (m[1] or "").strip(" -:.,")
        text = re.sub(r"\{@\w+[^}]*\}", "", text)
        if not _WORD.search(text) or _DIRECTIVE.match(text) or _PLACEHOLDER.match(text):
            continue
        if not text.endswith(".") and any(p.match(text) for p in _CODE):
            continue
        words = set(_name_words(text))
        if words <= own:
            continue
        said |= words
    return bool(said)


def _clean_block(lines: list[str]) -> str:
    """A comment's text without its marks."""
    out = []
    for x in lines:
        x = x.strip()
        x = re.sub(r"^(?:/\*+!?|//+[/!]?|#+!?)", "", x) if x.startswith(("/", "#")) else x
        x = re.sub(r"\*+/$", "", x)
        x = re.sub(r"^\s?\*+(?!\*)(?=\s|$|@)", "", x)
        out.append(x.strip())
    return "\n".join(out).strip("\n")


_DECORATOR = re.compile(r"^\s*@[A-Za-z_][\w.]*")
_QUOTED = re.compile(r"\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|`[^`]*+`")


def _bare(line: str, language: str | None) -> str:
    """A line of code without the contents of its strings and the comment at its end."""
    x = _QUOTED.sub('""', line)
    at = x.find("#" if language in _HASH else "//")
    return (x if at < 0 else x[:at]).rstrip()


def comment_above(lines: list[str], at: int, language: str | None) -> str:
    """The comment directly above line index ``at``; decorators and annotations may stand between."""
    i = at - 1
    while i >= 0:
        s = lines[i].strip()
        if _DECORATOR.match(s):
            i -= 1
        elif not s.startswith(("//", "#", "*", "/*")) and _bare(s, language).endswith(")"):
            j, depth = i, 0
            while j >= 0:  # back to the line that opens the call
                x = _bare(lines[j], language)
                depth += x.count(")") - x.count("(")
                if depth <= 0:
                    break
                j -= 1
            if j < 0 or depth or not _DECORATOR.match(lines[j]) or j == i:
                break
            i = j - 1
        else:
            break
    hashes = language in _HASH
    block: list[str] = []
    while i >= 0:
        s = lines[i].strip()
        if (hashes or language is None) and s.startswith("#") and not s.startswith("#!"):
            block.append(lines[i])
            i -= 1
        elif hashes:
            break
        elif s.startswith("//"):
            block.append(lines[i])
            i -= 1
        elif s.endswith("*/"):
            j = i
            while j >= 0 and "/*" not in lines[j]:
                j -= 1
            if j < 0 or not lines[j].strip().startswith("/*"):
                break
            block.extend(reversed(lines[j : i + 1]))
            i = j - 1
        else:
            break
    return _clean_block(block[::-1])


_DOCSTRING = re.compile(r"[rRuU]?(?:\"\"\"(?P<a>(?:[^\\]|\\.)*?)\"\"\"|'''(?P<b>(?:[^\\]|\\.)*?)'''|\"(?P<c>(?:[^\"\\\n]|\\.)*)\"|'(?P<d>(?:[^'\\\n]|\\.)*)')", re.S)
_SIGNATURE = re.compile(r"[^\"'#()\[\]{}:]+|\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|[()\[\]{}:]|.", re.S)
_GAP = re.compile(r"(?:[ \t\r]*(?:#[^\n]*)?\n)*[ \t]*")


def docstring(text: str, start: int) -> str:
    """The string that opens the body of the Python declaration at offset ``start``."""
    depth, pos = 0, -1
    for m in _SIGNATURE.finditer(text, start):
        t = m[0]
        if t in "([{" and len(t) == 1:
            depth += 1
        elif t in ")]}" and len(t) == 1:
            depth -= 1
        elif t == ":" and depth == 0:
            pos = m.end()
            break
    if pos < 0:
        return ""
    pos = _GAP.match(text, pos).end()
    m = _DOCSTRING.match(text, pos)
    if not m:
        return ""
    after = text[m.end() : m.end() + 1]
    if after and after not in "\r\n; \t#":
        return ""
    body = next((x for x in m.group("a", "b", "c", "d") if x is not None), "")
    return "\n".join(x.strip() for x in body.split("\n")).strip()


def documentation(lines: list[str], text: str, starts: list[int], line: int, language: str | None, name: str) -> str:
    """The first meaningful documentation of the declaration on a line (1-based), cleaned, or an empty text."""
    at = line - 1
    if not 0 <= at < len(lines):
        return ""
    begin = at
    while begin < len(lines) - 1 and _DECORATOR.match(lines[begin]):
        begin += 1
    if language == "python" or language is None and re.match(r"\s*(?:async\s+)?def\s", lines[begin]):
        doc = docstring(text, starts[begin])
        if doc and meaningful(doc, name):
            return doc
    doc = comment_above(lines, at, language)
    return doc if doc and meaningful(doc, name) else ""


_DECLARATION = re.compile(r"(?:[ \t]*@[^\n]*\n)*[ \t]*(?:[\w@]+[ \t]+)*?(?:class|interface|enum|record|trait|object|struct)\s+(\w+)(?:\s*\(([^)]*)\)|[^{;(]*?\b(?:extends|implements)\s+([^{;]*))")
_BETWEEN = re.compile(r",|\bimplements\b|\bextends\b|\bpermits\b|\bwith\b")


def bases_of(text: str, start: int, name: str) -> list[str]:
    """The names of the classes that the declaration of class ``name`` at offset ``start`` extends or implements."""
    m = _DECLARATION.match(text, start)
    if not m or m[1] != name:
        return []
    said = m[2] if m[2] is not None else m[3]
    while said != (said := re.sub(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", "", said)):
        pass
    out = []
    for x in _BETWEEN.split(said):
        x = x.strip().rsplit(".", 1)[-1]
        if re.fullmatch(r"\w+", x) and x not in ("object", "ABC", "Generic", "Protocol", name):
            out.append(x)
    return out


_FIELDS = ["symbol_id", "file_id", "project_path", "directory", "language", "parent_name", "name", "kind", "line", "end_line", "signature", "code", "documentation", "bases"]


def read(symbols: DataFrame, files: DataFrame, code: bool = True) -> DataFrame:
    """(symbol_id, file_id, project_path, directory, language, parent_name, name, kind, line, end_line, signature, code,
    documentation, bases) of the functions, methods, classes and types of each file.

    Only the file's content decides, not the symbol table's docstring column. ``documentation`` is that of a function or
    method, null where it is missing or trivial; ``bases`` are the classes that a class declares to extend or implement.
    Symbols and files meet on file_id, once; a file's symbols are read in one pass over its lines. Of symbols on one line
    the one indexed last counts; repeated payloads of a file give repeated rows (drop them on file_id, line). Symbols
    without file, with a null or impossible line, and files with null content give no row or a null documentation. A null
    end_line gives code of one line; without ``code`` that column is null.
    """
    want = symbols.where(F.col("kind").isin("function", "method", "class", "type") & F.col("line").isNotNull())
    directory = F.regexp_replace("file_path", r"/?[^/]*$", "").alias("directory") if "file_path" in symbols.columns else F.lit("").alias("directory")
    cols = ["symbol_id", "name", "kind", "line", "end_line", "language", "signature", "parent_name"]
    # one symbol per line before the lists are made: a list is as long as its file at most, however often it was indexed
    one = want.groupBy("file_id", "line").agg(F.max_by(F.struct(*cols, directory), F.struct(*(c for c in ("indexed_at",) if c in want.columns), "symbol_id")).alias("x"))
    per = one.groupBy("file_id").agg(F.collect_list("x").alias("_s"))
    src = files.where(F.col("content").isNotNull()).select("file_id", "project_path", "content").join(per, "file_id")
    kinds = dict(zip(_FIELDS, [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int32(), pa.int32(), *[pa.string()] * 3, pa.list_(pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                rows: list[list] = [[] for _ in _FIELDS]
                part = b.slice(i, 500)
                for fid, project, text, syms in zip(*(part.column(c).to_pylist() for c in ("file_id", "project_path", "content", "_s"))):
                    lines = text.split("\n")
                    starts, n = [], 0
                    for x in lines:
                        starts.append(n)
                        n += len(x) + 1
                    for s in syms:
                        name, line = s["name"] or "", s["line"]
                        doc = body = bases = None
                        if s["kind"] in ("class", "type"):
                            bases = bases_of(text, starts[line - 1], name) if 0 < line <= len(lines) else []
                        else:
                            doc = documentation(lines, text, starts, line, s["language"], name) or None
                            if code:
                                body = "\n".join(lines[line - 1 : max(line, s["end_line"] or 0)]) if line > 0 else ""
                        for c, v in zip(rows, (s["symbol_id"], fid, project, s["directory"], s["language"], s["parent_name"], name, s["kind"], line, s["end_line"], s["signature"], body, doc, bases)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds.values())], _FIELDS)

    schema = "symbol_id string, file_id bigint, project_path string, directory string, language string, parent_name string, name string, kind string, line int, end_line int, signature string, code string, documentation string, bases array<string>"
    return src.select("file_id", "project_path", "content", "_s").mapInArrow(run, schema)


def pairs_of(found: DataFrame) -> DataFrame:
    """The functions and methods of ``read``."""
    return found.where(F.col("kind").isin("function", "method")).drop("bases")


def hierarchy(found: DataFrame) -> DataFrame:
    """(file_id, class_name, base_file, base_class): each class of ``read`` with the classes it extends or implements.

    A class is known by its file and name, so that classes of one name stay apart. A base is looked up by name in the same
    file, else in the same directory, else in the project, among classes of the same language; where the nearest place has
    several of that name it stays unresolved. Each look-up is a join with a table of unique keys, so that a name that very
    many classes have multiplies nothing.
    """
    classes = found.where(F.col("kind").isin("class", "type") & (F.col("name") != ""))
    classes = classes.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("project_path", "directory", "language")), "file_id", F.col("name").alias("class_name"), "bases")
    edges = classes.select("project_path", "directory", "language", "file_id", "class_name", F.explode("bases").alias("base")).distinct()
    known = classes.select("project_path", "directory", "language", "file_id", F.col("class_name").alias("base")).distinct()
    here = known.select("file_id", "base", F.col("file_id").alias("_here"))
    only = lambda keys, name: known.groupBy(*keys, "base").agg(F.min("file_id").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    place = ["project_path", "language"]
    e = edges.join(here, ["file_id", "base"], "left").join(only([*place, "directory"], "_near"), [*place, "directory", "base"], "left").join(only(place, "_far"), [*place, "base"], "left")
    e = e.select("file_id", "class_name", F.coalesce("_here", "_near", "_far").alias("base_file"), F.col("base").alias("base_class"))
    return e.where("base_file is not null and not (base_file = file_id and base_class = class_name)")


def inherit(pairs: DataFrame, bases: DataFrame) -> DataFrame:
    """The pairs with documentation, own or inherited, with the class it comes from (documented_in) and how many steps up
    the hierarchy that is (level; 0 is the method's own).

    A method without documentation takes that of the method of the same name in a base class, the nearest first (of
    equally near ones the base least by name; of overloads the first). The search goes up the hierarchy by iterated joins
    of the methods that are still open with the bases of the classes they stand at; what was reached before is not reached
    again, so that it ends at a fixed point, in cycles too, however deep the hierarchy. Methods that stay without
    documentation, and undocumented functions, are dropped. Rows keep their multiplicity; a null class has no bases.
    """
    checkpoint_dir(pairs.sparkSession)
    pairs = materialize(pairs)  # read several times, mostly without the code
    own = pairs.where(F.col("documentation").isNotNull()).withColumn("documented_in", F.col("parent_name")).withColumn("level", F.lit(0))
    docs = own.where(F.col("parent_name").isNotNull()).groupBy("file_id", "parent_name", "name").agg(F.min_by("documentation", "line").alias("found"))
    docs = docs.select(F.col("file_id").alias("at_file"), F.col("parent_name").alias("at_class"), "name", "found").checkpoint()
    up = bases.select(F.col("file_id").alias("at_file"), F.col("class_name").alias("at_class"), "base_file", "base_class").distinct().checkpoint()
    lacking = pairs.where("documentation is null and parent_name is not null and kind = 'method'")
    method = ["file_id", "parent_name", "name"]
    place = [*method, "at_file", "at_class"]
    open_ = lacking.select(*method, F.col("file_id").alias("at_file"), F.col("parent_name").alias("at_class")).distinct().checkpoint()
    seen, resolved, level = open_, None, 0
    while not open_.isEmpty():
        level += 1
        step = open_.join(up, ["at_file", "at_class"]).select(*method, F.col("base_file").alias("at_file"), F.col("base_class").alias("at_class")).distinct()
        hit = step.join(seen, place, "left_anti").join(docs, ["at_file", "at_class", "name"], "left").checkpoint()
        got = hit.where("found is not null").groupBy(*method).agg(F.min(F.struct("at_class", "at_file", "found")).alias("x")).withColumn("level", F.lit(level))
        resolved = got if resolved is None else resolved.unionByName(got)
        open_ = hit.where("found is null").select(*place).join(got, method, "left_anti").checkpoint()
        seen = seen.unionByName(open_)
    if resolved is None:
        return own
    more = lacking.drop("documentation").join(resolved, method).withColumn("documentation", F.col("x.found")).withColumn("documented_in", F.col("x.at_class")).drop("x")
    return own.unionByName(more.select(own.columns))


def documented(symbols: DataFrame, files: DataFrame, code: bool = True) -> DataFrame:
    """Functions and methods with their documentation: ``read`` from the files, classes by ``hierarchy``, methods by
    ``inherit``; each declaration once."""
    checkpoint_dir(files.sparkSession)
    found = read(symbols, files, code).dropDuplicates(["file_id", "line"])
    found = materialize(found)
    return inherit(pairs_of(found), hierarchy(found))
