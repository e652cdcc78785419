"""Declarations of source files, by language: what they are, their names and the lines they take.

A language is an entry of a table: how its comments and literals look, and for each kind of declaration a pattern over the
text without them and how far it extends. New languages are new entries (``LANGUAGES``). The kinds are those that the
index knows: function, class, method, type; a function within a class is a method, and only classes are parents.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

Piece = tuple[str, int, int, str | None, str | None]  # kind, first line, last line, symbol, parent

_SLASHES, _BLOCK, _HASHES = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*\*/", r"(?:(?<=\s)|\A)#(?!\[)[^\n]*"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_TRIPLE, _BACK = r'"""(?:[^"\\]|\\.|"(?!""))*"""', r"`(?:[^`\\]|\\.)*`"
_CHAR = r"'(?:[^'\\\n]|\\.[^'\n]*)'"  # one character: an apostrophe may also begin a lifetime or a type variable


@dataclass
class Language:
    """``hidden``: patterns of comments and literals. ``kinds``: (kind, pattern with a group n for the name, extent).
    Extents: braces (to the brace that closes the first one; without one before a semicolon there is no declaration), open
    (the same, or to the semicolon), end (to the word that closes it), indent (to the next line that is not deeper), line,
    statement (to the semicolon)."""

    hidden: list[str]
    kinds: list[tuple[str, str, str]]
    opens: str = ""
    not_names: frozenset = frozenset()
    compiled: list = field(default_factory=list)
    mask: re.Pattern | None = None
    words: re.Pattern | None = None

    def __post_init__(self):
        self.mask = re.compile("|".join(self.hidden), re.S)
        ends = r"(?i:\bend(?:[ \t]*(?:subroutine|function|module|program|interface|type|do|select|if))?\b|\buntil\b)"
        self.words = re.compile(f"{self.opens}|{ends}" if self.opens else ends, re.M)
        self.compiled = [(k, re.compile(p, re.M), e) for k, p, e in self.kinds]


_NOT = frozenset("if for while switch catch return else do try new throw sizeof typeof await yield match loop when using lock synchronized function case in of and or not elif elsif foreach until unless super this assert import package delete with defer go select".split())
_NO_TYPES = _NOT | frozenset("public private protected internal static final abstract synchronized native default strictfp virtual override sealed partial extern unsafe readonly class struct enum interface record namespace using goto break continue extends implements throws".split())
_CURLY = [_SLASHES, _BLOCK]
_AFTER = r"(?:^|(?<=[{};]))[ \t]*"
_REGEX = r"(?:(?<=[=(,:!&|?{};\[\n>])|(?<=return)|(?<=[=(,:!&|?{};\[>][ ])|(?<=return[ ]))/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_SCRIPT = [*_CURLY, _BACK, _DOUBLE, _SINGLE, _REGEX]
_JS = [
    ("function", r"(?<![\w.$])(?:async[ \t]+)?function[ \t]*\*?[ \t]+(?P<n>[\w$]+)", "braces"), ("class", r"(?<![\w.$])class[ \t]+(?P<n>[\w$]+)(?=[^;=()]*\{)", "braces"),
    ("method", _AFTER + r"(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set|declare)[ \t]+)*\*?[ \t]*(?P<n>#?[\w$]+)[ \t]*(?:<[^>(){}]*>)?\([^;{}]*?\)[ \t]*(?::[^;{}=]+)?(?=\{)", "member"),
    ("function", r"(?P<n>)=>", "arrow"),
]
_TS = [*_JS, ("type", r"(?<![\w.$])interface[ \t]+(?P<n>[\w$]+)", "braces"), ("type", _AFTER + r"(?:export[ \t]+)?(?:declare[ \t]+)?type[ \t]+(?P<n>[\w$]+)(?:<[^=;]*>)?[ \t]*=", "alias")]
_TYPED = r"[A-Za-z_][\w.:]*(?:<[^;(){}]*>)?(?:\[\])*[?*&]*"
_C_BODY = r"(?:^|(?<=[};]))[ \t]*(?:[A-Za-z_][\w:<>,*&\[\] \t]*?[ \t*&])(?P<n>[~\w]+(?:::[~\w]+)*)[ \t\n]*\([^;{}]*\)[^;{}()=]*?(?=\{)"
_JAVA_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|strictfp|virtual|override|sealed|async|partial|extern|unsafe|new|readonly)[ \t]+)*"

LANGUAGES: dict[str, Language] = {
    "go": Language([*_CURLY, _BACK, _DOUBLE, _SINGLE], [("function", r"^func[ \t]+(?P<n>\w+)", "braces"), ("method", r"^func[ \t]*\([^)]*\)[ \t]*(?P<n>\w+)", "braces"), ("type", r"^[ \t]*type[ \t]+(?P<n>\w+)", "alias"), ("type", r"^[ \t]*type[ \t]*\((?P<n>)", "group")]),
    "javascript": Language(_SCRIPT, _JS, not_names=_NOT), "typescript": Language(_SCRIPT, _TS, not_names=_NOT), "tsx": Language(_SCRIPT, _TS, not_names=_NOT),
    "rust": Language([*_CURLY, _DOUBLE, _CHAR], [("function", r"\bfn[ \t]+(?P<n>\w+)", "braces"), ("class", r"\b(?:struct|enum)[ \t]+(?P<n>\w+)", "open"), ("type", r"\btrait[ \t]+(?P<n>\w+)", "braces")]),
    "java": Language([*_CURLY, _TRIPLE, _DOUBLE, _SINGLE], [
        ("class", r"(?<![\w.@])class[ \t]+(?P<n>\w+)", "braces"), ("type", r"(?<![\w.@])interface[ \t]+(?P<n>\w+)", "braces"),
        ("function", _AFTER + r"(?:@\w+(?:\([^()]*\))?[ \t]+)*" + _JAVA_MODS + r"(?:<[^;(){}]*>[ \t]*)?(?P<t>" + _TYPED + r")[ \t]+(?P<n>\w+)[ \t]*\(", "open")], not_names=_NOT),
    "c": Language([*_CURLY, _DOUBLE, _SINGLE], [("function", _C_BODY, "braces"), ("class", r"\bstruct[ \t]+(?P<n>\w+)[ \t\n]*(?=\{)", "braces"), ("type", r"\b(?:enum|union)[ \t]+(?P<n>\w+)[ \t\n]*(?=\{)", "braces"), ("type", r"\btypedef\b[^;{}]*(?:\{[^{}]*\}[^;{}]*)??(?P<n>\b\w+)[ \t]*(?=;)", "statement")], not_names=_NOT),
    "cpp": Language([*_CURLY, _DOUBLE, _SINGLE], [("function", _C_BODY, "braces"), ("class", r"(?<!enum )\b(?:class|struct)[ \t]+(?P<n>\w+)[^;{}()<>]*(?=\{)", "braces"), ("type", r"\b(?:enum(?:[ \t]+(?:class|struct))?|union|namespace)[ \t]+(?P<n>\w+)[^;{}()]*(?=\{)", "braces"), ("type", r"\btypedef\b[^;{}]*(?:\{[^{}]*\}[^;{}]*)?(?P<n>\b\w+)[ \t]*(?=;)", "statement")], not_names=_NOT),
    "python": Language([r"#[^\n]*", r'"""(?:[^"\\]|\\.|"(?!""))*"""', r"'''(?:[^'\\]|\\.|'(?!''))*'''", _DOUBLE, _SINGLE], [("function", r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>\w+)[ \t]*\(", "suite"), ("class", r"^[ \t]*class[ \t]+(?P<n>\w+)[ \t]*\(?", "suite")]),
    "ruby": Language([_HASHES, _DOUBLE, _SINGLE], [("function", _AFTER + r"def[ \t]+(?:self\.|\w+\.)?(?P<n>\w+[?!=]?)", "end"), ("class", _AFTER + r"(?:class|module)[ \t]+(?:\w+::)*(?P<n>[A-Z]\w*)", "end")], opens=r"(?:^|(?<=[;=(]))[ \t]*(?:def|class|module|if|unless|while|until|for|case|begin)\b|\bdo\b(?=[ \t]*(?:\|[^|]*\|)?[ \t]*(?:$|;))"),
    "c_sharp": Language([*_CURLY, _DOUBLE, _SINGLE], [
        ("class", r"(?<![\w.@])class[ \t]+(?P<n>\w+)", "braces"), ("type", r"(?<![\w.@])(?:interface|struct|enum|record(?:[ \t]+(?:class|struct))?)[ \t]+(?P<n>\w+)", "open"),
        ("method", _AFTER + r"(?:\[[^\]]*\][ \t]*)*" + _JAVA_MODS + r"(?P<t>" + _TYPED + r")[ \t]+(?P<n>\w+)[ \t]*(?:<[^>(){}]*>)?\(", "open")], not_names=_NOT),
    "php": Language([_SLASHES, _BLOCK, _HASHES, _DOUBLE, _SINGLE], [("class", r"(?<![\w$:])class[ \t]+(?P<n>\w+)", "braces"), ("type", r"(?<![\w$:])(?:interface|trait)[ \t]+(?P<n>\w+)", "braces"), ("function", r"(?<![\w$])(?:(?:public|private|protected|static|final|abstract)[ \t]+)*function[ \t]+&?(?P<n>\w+)", "open")]),
    "swift": Language([*_CURLY, _TRIPLE, _DOUBLE], [("function", r"(?<![\w.])func[ \t]+(?P<n>\w+)", "braces"), ("class", r"(?<![\w.])(?:class|struct|enum|extension|actor)[ \t]+(?!func\b|var\b)(?P<n>\w+)", "braces"), ("type", r"(?<![\w.])protocol[ \t]+(?P<n>\w+)", "braces")]),
    "kotlin": Language([*_CURLY, _TRIPLE, _DOUBLE, _SINGLE], [("function", r"(?<![\w.])fun[ \t]+(?:<[^>]*>[ \t]*)?(?:[\w<>?]+\.)?(?P<n>\w+)[ \t]*\(", "body"), ("class", r"(?<![\w.:])(?:class|interface|object)[ \t]+(?P<n>\w+)", "body")]),
    "scala": Language([*_CURLY, _TRIPLE, _DOUBLE], [("function", r"(?<![\w.])def[ \t]+(?P<n>\w+)", "body"), ("class", r"(?<![\w.])(?:class|object)[ \t]+(?P<n>\w+)", "body"), ("type", r"(?<![\w.])trait[ \t]+(?P<n>\w+)", "body")]),
    "bash": Language([r"<<-?[ \t]*\\?(?P<q>['\"]?)(?P<w>[A-Za-z_]\w*)(?P=q)[^\n]*\n(?:.*?\n)?\t*(?P=w)(?=\n|\Z)", r"\\.", r"\$\{[^{}]*\}", r'"(?:[^"\\]|\\.)*"', r"'[^']*'", r"(?:(?<=[\s;])|\A)#[^\n]*"], [("function", r"^[ \t]*function[ \t]+(?P<n>[A-Za-z_][\w:.-]*)[ \t]*(?:\([ \t]*\))?[ \t]*(?=\{)", "braces"), ("function", r"^[ \t]*(?!function\b)(?P<n>[A-Za-z_][\w:.-]*)[ \t]*\([ \t]*\)[ \t]*(?=\{)", "braces")]),
    "lua": Language([r"--\[\[.*?\]\]", r"--[^\n]*", _DOUBLE, _SINGLE], [("function", r"\bfunction[ \t]+(?P<n>[\w.:]+)[ \t]*\(", "end"), ("function", r"\bfunction(?P<n>)[ \t]*\(", "end")], opens=r"\b(?:function|if|do|repeat)\b(?<!else )"),
    "dart": Language([*_CURLY, _DOUBLE, _SINGLE], [("class", r"(?<![\w.])class[ \t]+(?P<n>\w+)", "braces"), ("type", r"(?<![\w.])(?:mixin|extension)[ \t]+(?P<n>\w+)", "braces"), ("function", _AFTER + r"(?:static[ \t]+|external[ \t]+|final[ \t]+)*(?P<t>" + _TYPED + r")[ \t]+(?P<n>\w+)[ \t]*\([^;{}]*?\)", "header")], not_names=_NOT),
    "r": Language([_HASHES, _DOUBLE, _SINGLE], [("function", r"\bfunction(?P<n>)[ \t]*\(", "body")]),
    "objc": Language([*_CURLY, _DOUBLE, _SINGLE], [("class", r"^[ \t]*@(?:interface|implementation)[ \t]+(?P<n>\w+)", "at_end"), ("type", r"^[ \t]*@protocol[ \t]+(?P<n>\w+)[^;]*$", "at_end"), ("method", r"^[ \t]*[-+][ \t]*\([^)]*\)[ \t]*(?P<n>\w+)[^;{}]*(?=\{)", "braces"), ("function", _C_BODY, "braces")], not_names=_NOT),
    "html": Language([r"<!--.*?-->"], [("type", r"(?i)<!doctype(?P<n>)[^>]*>", "line")]),
    "css": Language([_BLOCK, _DOUBLE, _SINGLE], [("class", r"(?:^|(?<=[{};]))[ \t]*(?!@)(?P<n>)[^\s{};@][^{};]*(?=\{)", "braces")]),
    "scss": Language([_SLASHES, _BLOCK, _DOUBLE, _SINGLE], [("function", r"@mixin[ \t]+(?P<n>[\w-]+)", "braces"), ("class", r"(?:^|(?<=[{};]))[ \t]*(?!@)(?P<n>)[^\s{};@$][^{};]*(?=\{)", "braces")]),
    "sql": Language([r"--[^\n]*", _BLOCK, _SINGLE], [("function", r"(?i)\bcreate\s+(?:or\s+replace\s+)?function\s+(?P<n>[\w.\"]+)", "statement"), ("type", r"(?i)\bcreate\s+(?:(?:global|local)\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(?P<n>[\w.\"]+)", "statement")]),
    "zig": Language([_SLASHES, _DOUBLE, _SINGLE], [("function", r"\bfn[ \t]+(?P<n>\w+)", "braces"), ("class", r"\bconst[ \t]+(?P<n>\w+)[ \t]*=[ \t]*(?:extern |packed )?struct\b", "braces")]),
    "julia": Language([r"#=.*?=#", _HASHES, _TRIPLE, _DOUBLE], [("function", _AFTER + r"function[ \t]+(?P<n>[\w.!]+)", "end")], opens=r"(?:^|(?<=[;=(]))[ \t]*(?:function|if|for|while|begin|let|try|macro|module|struct|mutable struct|quote)\b|\bdo\b"),
    "fortran": Language([r"![^\n]*", _DOUBLE, _SINGLE], [("function", r"(?i)^(?!\s*end\b)[ \t]*(?:[\w()=*, ]+[ \t])?(?:subroutine|function)[ \t]+(?P<n>\w+)", "end"), ("class", r"(?i)^[ \t]*module[ \t]+(?!procedure\b)(?P<n>\w+)", "end")], opens=r"(?i)^(?![ \t]*end)[ \t]*(?:(?:[\w()=*, ]+[ \t])?(?:subroutine|function)[ \t]+\w+|module[ \t]+(?!procedure\b)\w+|program\b|interface\b|type[ \t]*(?:::|,|[ \t]+\w+[ \t]*$)|do\b|select\b|if[ \t]*\(.*\)[ \t]*then)"),
    "haskell": Language([r"--[^\n]*", r"\{-.*?-\}", _DOUBLE], [("type", r"^(?:data|newtype)[ \t]+(?P<n>\w+)", "indent"), ("function", r"^(?!module\b|import\b|data\b|newtype\b|type\b|class\b|instance\b|where\b|infix)(?P<n>[a-z_][\w']*)(?=[^\n]*(?:::|=|\|))", "indent")]),
    "ocaml": Language([r"\(\*.*?\*\)", _DOUBLE], [("function", r"^[ \t]*let[ \t]+(?:rec[ \t]+)?(?P<n>[a-z_]\w*)", "indent"), ("class", r"^[ \t]*module[ \t]+(?!type\b)(?P<n>[A-Z]\w*)", "indent"), ("type", r"^[ \t]*type[ \t]+(?:'\w+[ \t]+|\([^)]*\)[ \t]*)?(?P<n>[a-z_]\w*)", "indent")]),
}


def masked(text: str, lang: Language) -> str:
    """The text with comments and literals blanked out, line by line as long as before."""
    return lang.mask.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_STOPS = re.compile(r"[{};(\[]")
_GOES_ON, _UNFINISHED = re.compile(r"\s*[.?:+\-*/&|=<>{]"), re.compile(r"(?:=>|[=+\-*/&|?:.,(])\s*\Z")
_SIGN = re.compile(r"[ \t]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[ \t]*)*(?::[ \t]*[\w<>\[\]., ?]+?)?[ \t]*(?:extends[^{\n]*|with[^{\n]*|:[^{\n=]*)?(?P<b>\{|=[ \t]*\{?)?")
_RETURNS, _WORD_BEFORE = re.compile(r"\)[ \t]*:[ \t]*[\w<>\[\]|. ]+\Z"), re.compile(r"[\w$]*\Z")
_BEFORE_ARROW = re.compile(r"(?:[=(,?\[{:;}]|=>|&&|\|\||\?\?|\breturn|\bdefault|>)\Z")
_HEADER_ENDS = re.compile(r"\s*(?:async\*?\s*)?(?:\{|=>|;)")
_COLON = re.compile(r"[ \t]*(?:->[^:\n]*)?:")
_SPACE = re.compile(r"\s*")
_GIVEN = re.compile(r"(?<![\w.$])(?:const|let|var)[ \t]+(?P<n>[\w$]+)[ \t]*(?::[^=;]*)?=[ \t\n]*(?:async[ \t]*)?\Z")
#: Characters before an arrow in which its parameters' end and what comes before them are sought.
_NEAR = 400


class _Extents:
    """Where declarations end, on a masked text."""

    def __init__(self, text: str, lang: Language):
        self.text, self.lang = text, lang
        self.pairs: dict[int, int] = {}
        self.back: dict[int, int] = {}
        stack: dict[str, list[int]] = {"}": [], ")": [], "]": []}
        close = {"{": "}", "(": ")", "[": "]"}
        for m in re.finditer(r"[{}()\[\]]", text):
            c = m[0]
            if c in close:
                stack[close[c]].append(m.start())
            elif stack[c]:
                a = stack[c].pop()
                self.pairs[a], self.back[m.start()] = m.start(), a

    def braces(self, at: int, without: str = "") -> int | None:
        """The brace that closes the first one from ``at`` on that stands before a semicolon, outside brackets."""
        i = at
        for m in _STOPS.finditer(self.text, at):
            p = m.start()
            if p < i:
                continue
            if m[0] in "([":
                i = self.pairs.get(p, p) + 1
            elif m[0] == "{":
                return self.pairs.get(p)
            elif m[0] == ";":
                return p if without == ";" else None
            else:
                return None
        return None

    def line_end(self, at: int) -> int:
        e = self.text.find("\n", at)
        return len(self.text) if e < 0 else e

    def expression(self, at: int, newline: bool) -> int:
        """The last offset of an expression from ``at`` on: it ends before a separator, a closing bracket or a line's end."""
        i, t = at, self.text
        while i < len(t):
            c = t[i]
            if c in "([{":
                i = min(self.pairs.get(i, len(t)) + 1, len(t))
                continue
            if c in ",;)]}" or c == "\n" and newline and t[at:i].strip() and not _GOES_ON.match(t, i) and not _UNFINISHED.search(t, max(at, i - 80), i):
                break
            i += 1
        while i > at + 1 and t[i - 1].isspace():
            i -= 1
        return max(at, i - 1)

    def end(self, at: int) -> int | None:
        """The word that closes the block that opens at or after ``at``."""
        depth = 0
        for m in self.lang.words.finditer(self.text, at):
            if m[0].lstrip()[:5].lower().startswith(("end", "until")):
                depth -= 1
                if depth <= 0:
                    return m.end() - 1
            else:
                depth += 1
        return None

    def indent(self, at: int, head: int | None = None) -> int:
        start = self.text.rfind("\n", 0, at) + 1
        last = self.line_end(at)
        deep = len(self.text[start:last]) - len(self.text[start:last].lstrip(" \t"))
        last = self.line_end(head or at)
        pos = last + 1
        while pos < len(self.text):
            e = self.line_end(pos)
            x = self.text[pos:e]
            if x.strip():
                if len(x) - len(x.lstrip(" \t")) <= deep:
                    break
                last = e
            pos = e + 1
        return last - 1

    def of(self, how: str, m: re.Match) -> tuple[int, int] | None:
        """(begin, last) offsets of a declaration that a pattern found."""
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        at = m.end() - m[0].endswith("(")
        if how in ("braces", "member"):
            e = self.braces(at)
        elif how == "open":
            e = self.braces(at, ";")
        elif how == "body":  # a block, else an expression
            i = at
            sign = _SIGN.match(self.text, i)
            b = sign["b"]
            e = self.pairs.get(sign.end() - 1) if b and b.endswith("{") else self.expression(sign.end(), True) if b or self.text[i : i + 1] == "(" and self.lang is LANGUAGES["r"] else max(begin, sign.end() - 1)
        elif how == "statement":
            e = self.text.find(";", at)
            e = len(self.text.rstrip()) - 1 if e < 0 else e
        elif how == "alias":
            e = self.expression(at, True)
        elif how == "header":
            e = at - 1 if _HEADER_ENDS.match(self.text, at) else None
        elif how == "end":
            e = self.end(begin)
        elif how == "at_end":
            e = self.text.find("@end", at)
            e = None if e < 0 else e + 3
        elif how == "indent":
            e = self.indent(m.start("n"))
        elif how == "suite":  # after a header that ends with a colon
            a = m.end("n") + len(m[0]) - (m.end("n") - m.start())
            head = self.pairs.get(a - 1) if m[0].endswith("(") else a - 1
            colon = None if head is None else _COLON.match(self.text, head + 1)
            e = self.indent(m.start("n"), colon.end()) if colon else None
        elif how == "arrow":
            left = m.start()
            while left > 0 and self.text[left - 1].isspace():
                left -= 1
            ret = _RETURNS.search(self.text, max(0, left - _NEAR), left)
            if ret:
                left = ret.start() + 1
            begin = self.back.get(left - 1) if self.text[left - 1 : left] == ")" else _WORD_BEFORE.search(self.text, max(0, left - _NEAR), left).start()
            if begin is None or begin == left:
                return None
            before = self.text[max(0, begin - _NEAR) : begin].rstrip()
            before = before.removesuffix("async").rstrip() if before.endswith("async") else before
            if before and not _BEFORE_ARROW.search(before):
                return None
            body = _SPACE.match(self.text, m.end()).end()
            e = self.pairs.get(body) if self.text[body : body + 1] == "{" else self.expression(body, True)
            if before.endswith(":") and re.fullmatch(r"[\w<>\[\]|. ]+", self.text[body : (e or body) + 1] or "-"):
                return None  # the type of a function
        else:
            e = self.line_end(at) - 1
        return None if e is None or e < begin else (begin, e)


def pieces(lines: list[str], language: str) -> list[Piece] | None:
    """The declarations of a file in a language of the table, in order of position; None where there are none."""
    lang = LANGUAGES[language]
    text = masked("\n".join(lines), lang)
    extents = _Extents(text, lang)
    found: list[tuple[int, int, str, str | None, str]] = []
    for kind, pattern, how in lang.compiled:
        for m in pattern.finditer(text):
            name = m["n"] or None
            if name in lang.not_names or "t" in pattern.groupindex and m["t"] in _NO_TYPES:
                continue
            if how == "group":  # declarations between brackets, one a line
                a = text.index("(", m.start())
                for g in re.finditer(r"(?:^|(?<=[(;]))[ \t]*(?P<n>\w+)[ \t]*(?=[^\s=)])", text[a + 1 : extents.pairs.get(a, len(text))], re.M):
                    at = a + 1 + g.start("n")
                    if not found or not found[-1][0] < at <= found[-1][1]:
                        found.append((at, extents.expression(a + 1 + g.end(), True), "type", g["n"], how))
                continue
            span = extents.of(how, m)
            if span:
                if how == "arrow":  # the name of the variable that it is given to
                    given = _GIVEN.search(text, max(0, span[0] - _NEAR), span[0])
                    name = given["n"] if given else None
                found.append((*span, kind, name, how))
    ends = [i for i, c in enumerate(text) if c == "\n"]
    out: list[Piece] = []
    seen: set[tuple[int, int, str]] = set()
    parents: list[tuple[int, str | None]] = []
    for begin, last, kind, name, how in sorted(found, key=lambda f: (f[0], -f[1])):
        while parents and parents[-1][0] < begin:
            parents.pop()
        if how == "member" and not parents or (begin, last, kind) in seen:
            continue  # what looks like a method outside a class is a call with a block
        seen.add((begin, last, kind))
        parent = parents[-1][1] if parents else None
        out.append(("method" if kind == "function" and parents else kind, bisect.bisect_left(ends, begin) + 1, bisect.bisect_left(ends, last) + 1, name, parent))
        if kind == "class":
            parents.append((last, name))
    return out or None
