"""Strings, paths and languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Languages by file name and by extension, as the index names them.
LANGUAGE_OF_NAME = {"CMakeLists.txt": "cmake", "Makefile": "make", "GNUmakefile": "make", "Dockerfile": "dockerfile"}
EXTENSIONS_OF_LANGUAGE = {
    "python": ".py", "go": ".go", "rust": ".rs", "java": ".java", "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp", "c_sharp": ".cs", "swift": ".swift", "kotlin": ".kt .kts",
    "scala": ".scala", "zig": ".zig", "julia": ".jl", "fortran": ".f90 .f95 .f03 .f", "objc": ".m .mm", "typescript": ".ts", "tsx": ".tsx", "javascript": ".js .jsx",
    "ruby": ".rb", "php": ".php", "lua": ".lua", "bash": ".sh .bash .zsh", "r": ".r", "dart": ".dart", "elixir": ".ex .exs", "erlang": ".erl", "haskell": ".hs",
    "ocaml": ".ml", "commonlisp": ".lisp .cl", "svelte": ".svelte", "html": ".html", "css": ".css", "scss": ".scss", "sql": ".sql", "yaml": ".yaml .yml", "json": ".json",
    "toml": ".toml", "xml": ".xml", "markdown": ".md", "graphql": ".graphql .gql", "regex": ".re", "hcl": ".tf .hcl", "cmake": ".cmake",
}
#: How the discovering client differs: what it lacks, adds and names otherwise.
_CLIENT_LACKS = frozenset("zig julia fortran objc tsx commonlisp graphql regex cmake".split())
_CLIENT_ADDS = {".tsx": "typescript", ".rst": "rst", ".proto": "protobuf", ".vue": "vue"}
_CLIENT_LACKS_EXT = frozenset((".kts", ".hcl"))

# Instructions that embedding models want before a query, by a part of the model's name.
QUERY_PREFIX = {
    "coderankembed": "Represent this query for searching relevant code: ",
    "nomic-embed-text": "search_query: ",
    "bge-base": "Represent this sentence for searching relevant passages: ",
    "bge-large": "Represent this sentence for searching relevant passages: ",
}


def extension_map(client: bool = False) -> dict[str, str]:
    """extension -> language, of the index or of the discovering client."""
    m = {e: lang for lang, es in EXTENSIONS_OF_LANGUAGE.items() for e in es.split()}
    if client:
        m = {e: lang for e, lang in m.items() if lang not in _CLIENT_LACKS and e not in _CLIENT_LACKS_EXT} | _CLIENT_ADDS
    return m


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only, as the index folds names."""
    return F.translate(c, _UPPER, _LOWER)


def like_folded(c: Column, pattern: str) -> Column:
    """LIKE without regard to ASCII case; % and _ in the pattern are live, nothing escapes them."""
    escape = next(x for x in "!~#@^|" if x not in pattern)
    return F.like(ascii_lower(c), F.lit(pattern.translate(str.maketrans(_UPPER, _LOWER))), F.lit(escape))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-cased last extension with its dot, or an empty text."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def _lookup(m: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), key)


def detect_language(path: Column) -> Column:
    """The index's language of a path: by exact file name, else by extension; null if unknown."""
    return F.coalesce(_lookup(LANGUAGE_OF_NAME, base_name(path)), _lookup(extension_map(), extension(path)))


def detect_language_client(path: Column) -> Column:
    """The discovering client's language of a path: by extension only; null if unknown."""
    return _lookup(extension_map(client=True), extension(path))


def relative_path(path: Column, root: Column) -> Column:
    """The path below root, or the path itself where it does not lie below it."""
    r = F.rtrim(root, F.lit("/"))
    return F.when(F.startswith(path, F.concat(r, F.lit("/"))), F.substr(path, F.length(r) + 2)).otherwise(path)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def directory_bucket(path: Column) -> Column:
    """First four parts of a path of four or more, first two of one of two or three, null for shorter ones."""
    p = path_parts(path)
    return F.when(F.size(p) > 3, F.array_join(F.slice(p, 1, 4), "/")).when(F.size(p) > 1, F.array_join(F.slice(p, 1, 2), "/"))


def ancestors(path: Column) -> Column:
    """The path and each directory above it, longest first, without the root."""
    p = F.split(path, "/")
    n = F.size(p)
    up = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(p, 1, n - i), "/"))
    return F.filter(up, lambda x: x != "")


def signature_of(content: Column) -> Column:
    """The first line, trimmed."""
    return F.trim(F.element_at(F.split(content, "\n", 2), 1), F.lit(" \t\r\n"))


def query_instruction(model: str) -> str:
    """``query_prefix`` of a name at hand."""
    return next((v for k, v in QUERY_PREFIX.items() if k in model.lower()), "")


def query_prefix(model: Column) -> Column:
    out, low = None, F.lower(model)
    for k, v in QUERY_PREFIX.items():
        out = F.when(F.contains(low, F.lit(k)), v) if out is None else out.when(F.contains(low, F.lit(k)), v)
    return out.otherwise("")


def human_age(seconds: Column) -> Column:
    """A duration in its largest unit: whole seconds and minutes, hours and days with a decimal, ties up (45s, 12m, 3.5h,
    2.0d)."""
    s = seconds.cast("bigint")
    whole = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    t = lambda n: F.floor((s * 10 + n // 2) / n)
    tenth = lambda n, u: F.concat(F.floor(t(n) / 10).cast("string"), F.lit("."), (t(n) % 10).cast("string"), F.lit(u))
    return F.when(s < 60, whole(1, "s")).when(s < 3600, whole(60, "m")).when(s < 86400, tenth(3600, "h")).otherwise(tenth(86400, "d"))


def first_hop(forwarded: Column, address: Column) -> Column:
    """The first address of a forwarding header, else the host of an address with port."""
    hop = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(F.when(hop != "", hop), F.regexp_replace(address, r":\d+$", ""))


def accepts(header: Column, media_type: str) -> Column:
    """Whether an Accept header names a media type."""
    return F.exists(F.split(header, ","), lambda x: F.lower(F.trim(F.element_at(F.split(x, ";"), 1))) == media_type)


def repository_of_directory(name: Column) -> Column:
    """owner__model -> owner/model, at the first double underscore."""
    return F.regexp_replace(name, r"^(.*?)__", "$1/")


def normalized_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def limiter_key(address: Column, email: Column) -> Column:
    """The key under which attempts of one address and account are counted."""
    return F.concat(address, F.lit("|"), normalized_email(email))


def key_prefix(key: Column, shown: int = 12) -> Column:
    """The part of a key that lists show: its first characters."""
    return F.substring(key, 1, shown)


def status_label(status: Column) -> Column:
    """A project's status as the command line shows it; unknown ones as they are."""
    out = F.when(status == "indexed", "\u2713 Indexed").when(status == "indexing", "\u23f3 Indexing")
    return out.when(status == "created", "\u25cb Created (not indexed)").when(status == "error", "\u2717 Error").otherwise(status)


def directory_of_repository(repository: Column) -> Column:
    """owner/model -> owner__model, at the first slash."""
    return F.regexp_replace(repository, r"^([^/]*)/", "$1__")


def rfc3339(at: Column) -> Column:
    """A timestamp as UTC text with microseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parsed_time(value: Column) -> Column:
    """A timestamp of a text, null where it is none."""
    return F.try_to_timestamp(value)


def int_or_zero(value: Column) -> Column:
    """A number kept as text in a map of metadata; 0 where it is missing or no number."""
    return F.coalesce(value.try_cast("int"), F.lit(0))
