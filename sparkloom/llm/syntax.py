"""Source files that are no valid source of their language."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import grammars

ERROR = "\ue000"
NEVER = "(?!)"


class Parser:
    """A grammar's table of productions, as recursive transition networks over one-character token codes.

    Each production becomes a named network whose states call other networks; the calls run on the matcher's own
    stack, in order of the alternatives and without going back into a finished one, so that a parse reads its tokens once
    but for bounded look-ahead.

    ``accepts`` parses a whole stream bottom-up through its nested groups (braces, or indented suites): the innermost
    group is parsed for each production that such a group can be, and becomes one code that stands for the set of those.
    Lists of statements are parsed piece by piece. As groups and pieces are short and recur, their results are kept in a
    chart by their codes, up to a bound. ``first_error`` is the index of the first token with which no sentence of the
    language continues, found on the whole network.
    """

    CHART = 200_000
    INLINE = 600

    def __init__(self, text: str, keep: str = "", drop: str = "", group: tuple[str, str] = ("", ""), lists: str = "", ends: str = "", goes_on: str = ""):
        """``group``: the terminals that open and close groups. ``lists``: rules that are closed under concatenation, of
        which pieces end after one of the terminals ``ends`` (GROUP: any group) unless one of ``goes_on`` follows."""
        rules: dict[str, str] = {}
        for line in text.strip().split("\n"):
            if drop and line.startswith(drop):
                continue
            if keep and line.startswith(keep):
                line = line[len(keep) :]
            name, body = line.split(" = ", 1)
            rules[name.strip()] = body.strip()
        self.codes: dict[str, str] = {}
        self.classes = {n: re.findall(r"'([^']+)'|(\S+)", b) for n, b in rules.items() if n.isupper()}
        self.rules = {n: b for n, b in rules.items() if not n.isupper()}
        self.roles: list[str] = []
        self.group = group
        self.open = self.close = ""
        if group[0]:
            self.open, self.close = (self.code(x) for x in group)
            edge = [x if x.isupper() else f"'{x}'" for x in group]
            self.roles = [n for n, b in self.rules.items() if b.startswith(edge[0] + " ") and b.endswith(" " + edge[1])]
            inner = re.compile(f"{self.open}([^{self.open}{self.close}]*){self.close}")
            self.innermost = inner
        full = {n: self._compile(b, False) for n, b in self.rules.items()}
        self.network = regex.compile(self._reachable(full, "file"))
        if self.roles:
            small = {n: self._compile(b, True) for n, b in self.rules.items() if n not in self.roles}
            bodies = {n: self._compile(self.rules[n][len(edge[0]) : -len(edge[1])], True) for n in self.roles}
            self.starts = {n: regex.compile(self._reachable(small | {"body": x}, "body")) for n, x in bodies.items()}
            self.starts["file"] = regex.compile(self._reachable(small, "file"))
            self.lists = set(lists.split())
            any_group = f"{chr(0xE800)}-{chr(0xE800 + (1 << len(self.roles)) - 1)}"
            cut = "".join(any_group if x == "GROUP" else self.code(x) for x in ends.split())
            stay = "".join(any_group if x == "GROUP" else self.code(x) for x in (*goes_on.split(), ")", "]"))
            self.pieces = re.compile(f"(?<=[{cut}])(?![{stay}])" if cut else NEVER)
            self.cuts = {self.close if x == "GROUP" else self.code(x) for x in ends.split()}
            self.stays = {self.open if x == "GROUP" else self.code(x) for x in (*goes_on.split(), ")", "]")}
            self.balance = [(self.codes[a], self.codes[b]) for a, b in ("()", "[]") if a in self.codes]
            self.chart: dict = {}
            self.memo: dict[str, str] = {}

    def _reachable(self, compiled: dict[str, str], start: str) -> str:
        """The network of what ``start`` can call. A called network costs a frame, so those that do not call themselves are
        put in place of their calls where they are short or called from few places; what is left is the recursive core."""
        call = re.compile(r"\(\?&(\w+)\)")
        rules = dict(compiled)
        while True:
            need, todo = {start}, [start]
            while todo:
                for n in call.findall(rules[todo.pop()]):
                    if n not in need:
                        need.add(n)
                        todo.append(n)
            rules = {n: rules[n] for n in rules if n in need}
            calls = {n: sum(x.count(f"(?&{n})") for x in rules.values()) for n in rules}
            fit = [n for n, x in rules.items() if n != start and f"(?&{n})" not in x and (calls[n] - 1) * len(x) <= self.INLINE]
            if not fit:
                return "(?(DEFINE)" + "".join(f"(?P<{n}>{x})" for n, x in rules.items()) + f")(?&{start})"
            n = min(fit, key=lambda n: (calls[n] - 1) * len(rules[n]))
            rules = {k: x.replace(f"(?&{n})", f"(?>{rules[n]})") for k, x in rules.items() if k != n}

    def code(self, terminal: str) -> str:
        return self.codes.setdefault(terminal, chr(0xE010 + len(self.codes)))

    def _members(self, name: str) -> str:
        if name not in self.classes:
            return self.code(name)
        return "".join(self._members(word) if word else self.code(quoted) for quoted, word in self.classes[name])

    def _compile(self, body: str, grouped: bool) -> str:
        tokens = re.findall(r"'[^']+'|[A-Za-z_]+|[()|?*+&!]", body)
        pos = 0

        def choice() -> str:
            nonlocal pos
            out = [sequence()]
            while pos < len(tokens) and tokens[pos] == "|":
                pos += 1
                out.append(sequence())
            return "(?>" + "|".join(out) + ")" if len(out) > 1 else out[0]

        def sequence() -> str:
            nonlocal pos
            out = []
            while pos < len(tokens) and tokens[pos] not in "|)":
                out.append(item())
            return "".join(out)

        def item() -> str:
            nonlocal pos
            t = tokens[pos]
            pos += 1
            if t in "&!" and len(t) == 1:
                x = item()
                return ("(?=" if t == "&" else "(?!") + (f"{x}|\\Z" if grouped and x == self.close else x) + ")"
            if t == "(":
                x = "(?>" + choice() + ")"
                pos += 1
            elif t[0] == "'":
                x = self.code(t[1:-1])
            elif t == "END":
                x = r"\Z"
            elif t == "NEVER":
                x = NEVER
            elif t.isupper():
                m = self._members(t)
                x = f"[{m}]" if len(m) > 1 else m
            elif grouped and t in self.roles:
                bit = 1 << self.roles.index(t)
                x = "[" + "".join(chr(0xE800 + i) for i in range(1 << len(self.roles)) if i & bit) + "]"
            else:
                x = f"(?&{t})"
            if pos < len(tokens) and tokens[pos] in "?*+" and len(tokens[pos]) == 1:
                x = (x if len(x) == 1 or x[0] == "[" or x[-1] == ")" and x[0] == "(" else f"(?:{x})") + tokens[pos] + "+"
                pos += 1
            return x

        return choice()

    def accepts(self, stream: str) -> bool:
        if ERROR in stream:
            return False
        if not self.roles:
            return self.network.fullmatch(stream) is not None
        depth = stream.count(self.open)
        if depth != stream.count(self.close):
            return False
        nothing = chr(0xE800)
        while depth:
            stream = self.innermost.sub(self._reduce, stream)
            if nothing in stream:
                return False
            left = stream.count(self.open)
            if left == depth:
                return False
            depth = left
        return self._is("file", stream)

    def _reduce(self, m: re.Match) -> str:
        content = m[1]
        c = self.memo.get(content)
        if c is None:
            if len(self.memo) > self.CHART:
                self.memo.clear()
            c = self.memo[content] = chr(0xE800 + sum(1 << i for i, r in enumerate(self.roles) if self._is(r, content)))
        return c

    def _is(self, rule: str, content: str) -> bool:
        """Whether a group's content (or the file) is one of the rule's; as a list, if all its pieces are, else as a whole."""
        start, chart = self.starts[rule], self.chart
        if rule in self.lists and len(content) > 8:
            held, tries = "", 0
            for p in self.pieces.split(content):
                held += p
                if not p:
                    continue
                if all(held.count(a) == held.count(b) for a, b in self.balance):
                    known = chart.get((rule, held))
                    if known is None:
                        if len(chart) > self.CHART:
                            chart.clear()
                        known = chart[(rule, held)] = start.fullmatch(held) is not None
                    if known:
                        held, tries = "", 0
                    elif tries < 6:  # the next piece may belong to it
                        tries += 1
                    else:
                        break
            else:
                if not held:
                    return True
        return start.fullmatch(content) is not None

    def _sound(self, stream: str) -> int:
        """The length of leading whole pieces of the file that are valid, 0 where the file is no list of pieces."""
        if not self.roles or "file" not in self.lists:
            return 0
        depth = done = tries = 0
        for i, c in enumerate(stream):
            if c == self.open:
                depth += 1
            elif c == self.close:
                depth -= 1
                if depth < 0:
                    return done
            if depth or c not in self.cuts or stream[i + 1 : i + 2] in self.stays:
                continue
            if self.accepts(stream[done : i + 1]):
                done, tries = i + 1, 0
            elif tries < 6:
                tries += 1
            else:
                return done
        return done

    def first_error(self, stream: str) -> int:
        """Found by bisection in what follows the sound pieces: the longest prefix that is the beginning of some sentence."""
        end = stream.find(ERROR) if ERROR in stream else len(stream)
        sound = self._sound(stream[:end])
        for begin in (sound, 0) if sound else (0,):
            part = stream[begin:end]
            if self.network.fullmatch(part, partial=True):  # cut short: nothing but the end is wrong
                if begin and end == len(stream) and self.network.fullmatch(part):
                    continue  # sound pieces in a wrong order
                return end
            lo, hi = 0, len(part)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if self.network.fullmatch(part[:mid], partial=True):
                    lo = mid
                else:
                    hi = mid - 1
            return begin + lo
        return end


class Lexer(dict):
    """lexeme -> codes. The scan is one compiled pattern; a lexeme is classified once and kept, up to a bound."""

    LIMIT = 300_000

    def __init__(self, parser: Parser, scan: str, kinds: list[tuple[str, str]], words: str = "", flags: int = 0):
        super().__init__()
        self.parser = parser
        self.scan = regex.compile(scan, flags | regex.VERBOSE) if "(?&" in scan or "(?1)" in scan else re.compile(scan, flags | re.VERBOSE)
        self.kinds = [(re.compile(p, re.S), k) for p, k in kinds]
        self.fixed = {t: c for t, c in parser.codes.items() if not t.isupper()}
        if words:
            self.fixed |= {w: ERROR for w in words.split() if w not in self.fixed}

    def __missing__(self, lexeme: str) -> str:
        c = self.fixed.get(lexeme)
        if c is None:
            c = ERROR
            for p, k in self.kinds:
                if p.fullmatch(lexeme):
                    c = self.parser.code(k) if k and k[0] != "=" else "" if not k else "".join(self.parser.code(x) for x in k[1:].split())
                    break
        if len(self) > self.LIMIT:
            self.clear()
        self[lexeme] = c
        return c

    def lexemes(self, text: str) -> list[tuple[int, str]]:
        return [(m.start(), m[0]) for m in self.scan.finditer(text)]

    def stream(self, text: str) -> str:
        return "".join(map(self.__getitem__, self.scan.findall(text)))

    def offsets(self, text: str) -> list[int]:
        """The offset of each code of ``stream``, for languages whose streams are not rearranged."""
        out = []
        for at, x in self.lexemes(text):
            out += [at] * len(self[x])
        return out


_C_COMMENT = r"//[^\n]*+ | /\*(?:[^*]|\*(?!/))*+\*/"
_NUMBER = r"(?: (?<![\w.])\.\d | \d )(?:[eE][+-]\d|[\w.])*+"
_NUM_OK = r"0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[nLl]?|0[bB][01_]+[nLl]?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[nLlfFdDij]?"
_DQ = r'"(?:[^"\\\n]|\\.)*+"'
_SQ = r"'(?:[^'\\\n]|\\.)*+'"


def _operators(parser: Parser, extra: str = "") -> str:
    ops = {t for t in parser.codes if not t[0].isalnum() and t[0] != "_" and not t.isupper()} | set(extra.split())
    return " | ".join(re.escape(t).replace("#", r"\#") for t in sorted(ops, key=lambda t: (-len(t), t)))


# -- languages whose tokens need no layout ----------------------------------------------------------------------------


class Json:
    def __init__(self):
        self.parser = Parser(grammars.JSON)
        self.lexer = Lexer(self.parser, rf'{_DQ} | -?[\w.+\-]+ | [{{}}\[\],:] | \S', [(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', "STR"), (r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", "NUM")])

    def stream(self, text: str) -> str:
        if text.translate(_JSON_SPACE) != text:
            return ERROR
        return self.lexer.stream(text)

    def offset(self, text: str, i: int) -> int:
        o = self.lexer.offsets(text)
        return o[i] if i < len(o) else len(text)


_JSON_SPACE = dict.fromkeys([0x0B, 0x0C, 0x85, 0xA0, 0x2028, 0x2029], None)


class Java(Json):
    def __init__(self):
        self.parser = p = Parser(grammars.JAVA, group=("{", "}"), lists="block body file", ends="; GROUP", goes_on="; , . ( else catch finally while -> : ? = &&")
        words = "assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while _"
        self.lexer = Lexer(p, rf'{_C_COMMENT} | """(?:[^"\\]|\\.|"(?!""))*+""" | {_DQ} | {_SQ} | [A-Za-z_$\u0080-\uffff][\w$]*+ | {_NUMBER} | {_operators(p, "- >")} | \S',
            [(r"//.*|/\*.*\*/", ""), (r'".*"', "STR"), (r"'(?:[^'\\]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.|[\ud800-\udbff][\udc00-\udfff])'", "CHAR"), (r"[A-Za-z_$\u0080-\uffff][\w$]*", "ID"), (_NUM_OK, "NUM")], words, re.S)

    def stream(self, text: str) -> str:
        return self.lexer.stream(text)


class Go:
    def __init__(self):
        self.parser = p = Parser(grammars.GO, group=("{", "}"), lists="block struct_body interface_body", ends=";")
        words = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
        self.lexer = Lexer(p, rf"\n | {_C_COMMENT} | {_DQ} | `[^`]*+` | {_SQ} | [A-Za-z_\u0080-\uffff]\w*+ | {_NUMBER} | {_operators(p)} | \S",
            [(r"\n", "NEWLINE"), (r"//.*", ""), (r"/\*[^\n]*\*/", ""), (r"/\*.*\*/", "NEWLINE"), (r'".*"|`.*`', "STR"), (r"'(?:[^'\\]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{3}|\\[abfnrtv\\'\"])'", "NUM"), (r"[^\W\d]\w*", "ID"), (_NUM_OK, "NUM")], words, re.S)
        nl, semi = p.code("NEWLINE"), p.code(";")
        ends = "".join(p.code(x) for x in ("ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))
        self.insert = re.compile(f"(?<=[{ends}]){nl}+")
        self.nl, self.semi = nl, semi

    def stream(self, text: str) -> str:
        return self.insert.sub(self.semi, self.lexer.stream(text) + self.nl).replace(self.nl, "")

    def offset(self, text: str, i: int) -> int:
        """Inserted semicolons shift codes: count those that stand for lexemes."""
        s = self.insert.sub(lambda m: self.semi + self.nl * (len(m[0]) - 1), self.lexer.stream(text) + self.nl)
        offsets = [*self.lexer.offsets(text), len(text)]
        kept = [o for o, c in zip(offsets, s) if c != self.nl]
        return kept[i] if i < len(kept) else len(text)


class EcmaScript:
    def __init__(self, typed: bool):
        self.parser = p = Parser(grammars.ECMASCRIPT, *(("ts:", "js:") if typed else ("js:", "ts:")), group=("{", "}"), lists="block class_body file" + " object_type" * typed, ends="; N", goes_on="else while N ;")
        before = r"(?: (?<=[=(,:;!&|?\[{{}}+*~^<>%\n]) | (?<=[=(,:;!&|?\[{{}}+*~^<>%\n][ \t]) | (?<=return[ ]) | (?<=[ ][ ]) )".replace("{{", "{").replace("}}", "}")
        tpl = r"`(?:[^`\\$] | \\. | \$(?!\{) | \$\{(?:[^{}`\"'] | \"(?:[^\"\\\n]|\\.)*+\" | '(?:[^'\\\n]|\\.)*+' | \{(?:[^{}`]|\{[^{}`]*+\})*+\} | `(?:[^`\\]|\\.)*+`)*+\})*+`"
        words = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with"
        # contextual words of the typed language are plain names in the other
        self.lexer = Lexer(p, rf"\n | {_C_COMMENT} | {_DQ.replace('.', '[^~]').replace('[^~]', '(?s:.)')} | {_SQ.replace('.', '(?s:.)')} | {tpl} | {before} /(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*+ | \#?[A-Za-z_$\u0080-\uffff][\w$]*+ | {_NUMBER} | {_operators(p)} | \S",
            [(r"\n|/\*.*\n.*\*/", "NL"), (r"//.*|/\*.*\*/", ""), (r'".*"|\'.*\'', "STR"), (r"`.*`", "TPL"), (r"/.+/[dgimsuvy]*", "REGEX"), (r"#[A-Za-z_$\u0080-\uffff][\w$]*", "PRIVATE"), (r"[A-Za-z_$\u0080-\uffff][\w$]*", "ID"), (_NUM_OK, "NUM")], words, re.S)
        n = p.code("N")
        nl = p.code("NL")
        words_that_end = "return break continue this super true false null debugger".split()
        ends = "".join(p._members("NAME")) + "".join(p.code(x) for x in ("NUM", "STR", "TPL", "REGEX", "PRIVATE", ")", "]", "}", "++", "--", "!", ">", "?", "void", *words_that_end))
        if not typed:
            ends = ends.replace(p.code("!"), "").replace(p.code(">"), "").replace(p.code("?"), "").replace(p.code("void"), "")
        goes_on = "".join(p.code(x) for x in (")", "]", "}", ",", ";", ".", "?.", "?", ":", "=", "==", "===", "!=", "!==", "<=", ">=", "&&", "||", "??", "|", "&", "^", "%", "**", "=>", "instanceof", "in", "else", "catch", "finally", "+=", "-=", "<<")) + p.code("extends")
        self.keep = re.compile(f"(?<=[{ends}]){nl}+(?![{nl}{goes_on}])")
        # `}` before a template, bracket or operator sign may still end a statement: those newlines stay
        self.n, self.nl = n, nl

    def stream(self, text: str) -> str:
        if text.startswith("#!"):
            text = "//" + text[2:]
        return self.keep.sub(self.n, self.lexer.stream(text)).replace(self.nl, "")

    def offset(self, text: str, i: int) -> int:
        s = self.keep.sub(lambda m: self.n + self.nl * (len(m[0]) - 1), self.lexer.stream(text))
        kept = [o for o, c in zip(self.lexer.offsets(text), s) if c != self.nl]
        return kept[i] if i < len(kept) else len(text)


class Python:
    def __init__(self):
        self.parser = p = Parser(grammars.PYTHON, group=("IND", "DED"), lists="suite file", ends="NL GROUP", goes_on="elif else except finally GROUP")
        pre = "(?:[rRbBuUfFtT]|[bBfFtT][rR]|[rR][bBfFtT])?"
        words = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
        self.lexer = Lexer(p, rf'''(?:\r?\n[ \t\f]*+(?:\#[^\n]*+)?)++ | \\\r?\n | \#[^\n]*+ | {pre}"""(?:[^"\\]|\\.|"(?!""))*+""" | {pre}\'\'\'(?:[^'\\]|\\.|'(?!''))*+\'\'\' | {pre}"(?:[^"\\\n]|\\.)*+" | {pre}'(?:[^'\\\n]|\\.)*+' | [^\W\d]\w*+ | {_NUMBER} | {_operators(p)} | \S''',
            [(r"\r?\n.*", "NL"), (r"\\\r?\n|#.*", ""), (r"[rRbBuUfFtT]{0,2}(?:\".*\"|'.*')", "STR"), (r"[^\W\d]\w*", "ID"), (r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[jJ]", "NUM")], words, re.S)
        self.nl, self.ind, self.ded = p.code("NL"), p.code("IND"), p.code("DED")
        self.opening, self.closing = {p.code(x) for x in "([{"}, {p.code(x) for x in ")]}"}
        self.special = self.opening | self.closing | {self.nl}

    def _codes(self, text: str) -> list[str]:
        lexemes = self.lexer.scan.findall("\n" + text)
        codes = list(map(self.lexer.__getitem__, lexemes))
        depth, stack, any_code = 0, [0], False
        special = self.special
        last = len(codes) - 1
        while last >= 0 and codes[last] in ("", self.nl):
            last -= 1
        for i, c in enumerate(codes):
            if c not in special:
                any_code = any_code or c != ""
                continue
            if c in self.opening:
                depth += 1
                any_code = True
            elif c in self.closing:
                depth -= 1
            elif depth > 0:
                codes[i] = ""
            else:
                if i > last:
                    codes[i] = self.nl if any_code and i == last + 1 else ""
                    continue
                x = lexemes[i]
                col = x[x.rfind("\n") + 1 :]
                col = len(col.expandtabs(8)) if "\t" in col else len(col)
                out = self.nl if any_code else ""
                if col > stack[-1]:
                    stack.append(col)
                    out += self.ind
                else:
                    while col < stack[-1]:
                        stack.pop()
                        out += self.ded
                    if col != stack[-1]:
                        out += ERROR
                codes[i] = out
        if any_code and (not codes or not "".join(codes[last + 1 :])):
            codes.append(self.nl)
        codes.append(self.ded * (len(stack) - 1))
        return codes

    def stream(self, text: str) -> str:
        return "".join(self._codes(text))

    def offset(self, text: str, i: int) -> int:
        at = [max(0, o - 1) for o, _ in self.lexer.lexemes("\n" + text)]
        n = 0
        for o, c in zip(at, self._codes(text)):
            n += len(c)
            if n > i:
                return o
        return len(text)


class Hcl(Json):
    def __init__(self):
        self.parser = p = Parser(grammars.HCL, group=("{", "}"), lists="body file", ends="N")
        # the string's own network: quotes, escapes and templates nest
        text = r'(?P<s>"(?:[^"\\$%\n]|\\.|[$%]{1,2}(?!\{)|[$%][$%]\{|[$%](?P<b>\{(?:[^{}"]|(?&s)|(?&b))*+\}))*+")'
        self.lexer = Lexer(p, rf"\n | \#[^\n]*+ | {_C_COMMENT} | <<-?(?P<w>[A-Za-z_]\w*)\r?\n(?:[^\n]*+\n)*?[ \t]*+(?P=w)(?=\r?\n|\Z) | {text} | [A-Za-z_][\w\-]*+ | {_NUMBER} | {_operators(p)} | \S",
            [(r"\n", "N"), (r"#.*|//.*|/\*.*\*/", ""), (r"<<.*", "HEREDOC"), (r'".*"', "STR"), (r"[A-Za-z_][\w\-]*", "ID"), (_NUM_OK, "NUM")], "", re.S)
        scan = self.lexer.scan
        self.lexer.scan = type("Scan", (), {"findall": staticmethod(lambda t: [m[0] for m in scan.finditer(t)]), "finditer": staticmethod(scan.finditer)})()
        self.lexer.fixed.pop("for", None)
        self.lexer.fixed.pop("in", None)
        self.lexer.fixed.pop("if", None)
        self.lexer.fixed |= {w: p.code(w) for w in ("for", "in", "if")}

    def stream(self, text: str) -> str:
        return self.lexer.stream(text)


class Bash(Json):
    def __init__(self):
        self.parser = p = Parser(grammars.BASH)
        quote = r"""(?P<dq>"(?:[^"\\$`]|\\.|(?&dol)|`(?:[^`\\]|\\.)*+`|\$)*+")"""
        dollar = r"""(?P<dol>\$(?:\(\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\)\)|(?P<par>\((?:[^()'"`\\$\#]|\\.|\#|'[^']*+'|(?&dq)|`(?:[^`\\]|\\.)*+`|(?&dol)|\$|(?&par))*+\))|\{(?:[^{}'"`\\$]|\\.|'[^']*+'|(?&dq)|(?&dol)|\$|\{[^{}]*+\})*+\}|'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[\w@*\#?$!\-]))"""
        piece = rf"""[^\s;&|<>()'"`$\\] | \\. | '[^']*+' | {quote} | {dollar} | `(?:[^`\\]|\\.)*+` | \$"""
        self.lexer = Lexer(p, rf"""\n | \\\r?\n | (?<![^\s;|&()])\#[^\n]*+ | \(\((?:[^()\n]|\((?:[^()\n]|\([^()\n]*+\))*+\))*+\)\) | \[\[(?=\s) | [<>]\((?:[^()]|\([^()]*+\))*+\) | (?:[A-Za-z_]\w*+(?:\[[^\]\n]*+\])?\+?=)?+(?!\#)(?:{piece})++ | [A-Za-z_]\w*+(?:\[[^\]\n]*+\])?\+?= | {_operators(p, "- ;;")} | \S""",
            [(r"\n", "N"), (r"\\\r?\n|#.*", ""), (r"\(\(.*\)\)", "ARITH"), (r"[<>]\(.*\)", "WORD"), (r"\d+", "NUMBER"), (r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=.*", "ASSIGN"), (r"[^;&|<>()\s].*", "WORD")], "", re.S)
        scan = self.lexer.scan
        self.lexer.scan = type("Scan", (), {"findall": staticmethod(lambda t: [m[0] for m in scan.finditer(t)]), "finditer": staticmethod(scan.finditer)})()
        for x in ('"', "'", "`", "$(", "${"):
            self.lexer.fixed[x] = ERROR
        # a number is a redirection's only directly before it
        number, redirections = p.code("NUMBER"), p._members("REDIR")
        self.heredoc = re.compile(r"(?<![<$(\w])<<(-?)[ \t]*\\?(['\"]?)([A-Za-z_][\w.]*)\2(?=[\s;|&)>]|$)", re.M)

    def _without_documents(self, text: str) -> str | None:
        """The text with the bodies of here-documents emptied, or None where one does not end."""
        out, at = [], 0
        while True:
            m = self.heredoc.search(text, at)
            if not m:
                return "".join(out) + text[at:]
            line = text.rfind("\n", 0, m.start()) + 1
            before = text[line : m.start()]
            if before.lstrip().startswith("#") or before.count("'") % 2 or " #" in before:
                out.append(text[at : m.end()])
                at = m.end()
                continue
            eol = text.find("\n", m.end())
            end = re.compile(r"(?m)^" + (r"\t*" if m[1] else "") + re.escape(m[3]) + r"\r?$").search(text, eol + 1) if eol >= 0 else None
            if not end:
                return None
            out.append(text[at : eol + 1] + "\n" * text.count("\n", eol + 1, end.start()))
            at = end.end()

    def stream(self, text: str) -> str:
        if "<<" in text:
            t = self._without_documents(text)
            if t is None:
                return ERROR
            text = t
        return self.lexer.stream(text.replace("\r\n", "\n"))

    def offset(self, text: str, i: int) -> int:
        t = self._without_documents(text) or text
        o = self.lexer.offsets(t.replace("\r\n", "\n"))
        line = t.replace("\r\n", "\n").count("\n", 0, o[i]) if i < len(o) else text.count("\n")
        pos = 0
        for _ in range(line):
            pos = text.find("\n", pos) + 1
        return pos


class Yaml:
    """The lexer follows indentation: IND and DED frame each deeper level, DASH opens one for its content."""

    def __init__(self):
        self.parser = p = Parser(grammars.YAML)
        self.c = {k: p.code(k) for k in "DOC ENDDOC DIRECTIVE SEP IND DED DASH COLON PLAIN DQ SQ BLOCK ALIAS ANCHOR TAG [ ] { } ,".split()}
        self.token = re.compile(
            r"""[ \t]+(?:\#[^\n]*)?|\#(?<=^\#)[^\n]*|(?P<DQ>"(?:[^"\\]|\\.)*+")|(?P<SQ>'(?:[^']|'')*+')|(?P<BLOCK>[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:\#[^\n]*)?\r?$)|(?P<DASH>-(?=[ \t\r\n]|\Z))|(?P<Q>\?(?=[ \t\r\n]))
            |(?P<COLON>:(?=[ \t\r\n]|\Z))|(?P<FC>:)|(?P<ANCHOR>&[^\s,\[\]{}]+)|(?P<ALIAS>\*[^\s,\[\]{}]+)|(?P<TAG>![^\s,\[\]{}]*)|(?P<B>[\[\]{},])""",
            re.X | re.S | re.M,
        )
        self.plain = re.compile(r"(?:[^\s\-?:,\[\]{}\#&*!|>'\"%@`]|[\-?:](?=[^\s]))(?:[^\s:\#]|:(?=\S)|(?<=\S)\#|[ \t]+(?=[^\s\#:]|:\S))*")
        self.flow_plain = re.compile(r"(?:[^\s\-?:,\[\]{}\#&*!|>'\"%@`]|[\-?:](?=[^\s,\[\]{}]))(?:[^\s:\#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)\#|[ \t]+(?=[^\s\#:,\[\]{}]|:[^\s,\[\]{}]))*")

    def tokens(self, text: str) -> list[tuple[int, str]]:
        c, out, stack, depth = self.c, [], [0], 0
        pos, n = 0, len(text)
        started = False
        while pos < n:
            eol = text.find("\n", pos)
            eol = n if eol < 0 else eol
            line = text[pos:eol].rstrip("\r")
            body = line.lstrip(" ")
            if not body.strip() or body.startswith("#"):
                pos = eol + 1
                continue
            if body[0] == "\t":
                if not body.strip():
                    pos = eol + 1
                    continue
                return [*out, (pos, ERROR)]
            col = len(line) - len(body)
            if col == 0 and (line[:3] in ("---", "...") and (len(line) == 3 or line[3] in " \t")):
                while len(stack) > 1:
                    stack.pop()
                    out.append((pos, c["DED"]))
                stack = [0]
                out.append((pos, c["DOC" if line[0] == "-" else "ENDDOC"]))
                rest = line[3:].strip()
                if rest and not rest.startswith("#"):
                    pos += 3
                    if rest[0] in "|>":
                        pass
                    else:
                        while text[pos] in " \t":
                            pos += 1
                    col = 0
                else:
                    pos = eol + 1
                    continue
            elif col == 0 and line[0] == "%" and not started:
                out.append((pos, c["DIRECTIVE"]))
                pos = eol + 1
                continue
            else:
                pos += col
                if col > stack[-1]:
                    if not started and len(stack) == 1:
                        stack = [col]
                    else:
                        stack.append(col)
                        out.append((pos, c["IND"]))
                else:
                    while len(stack) > 1 and col < stack[-1]:
                        stack.pop()
                        out.append((pos, c["DED"]))
                    if col != stack[-1]:
                        return [*out, (pos, ERROR)]
            started = True
            start = pos - col
            first = True
            while pos < n:  # one line, or more where brackets or quotes run on
                ch = text[pos]
                if ch in " \t":
                    pos += 1
                    continue
                if ch == "\r" and text[pos : pos + 2] == "\r\n":
                    pos += 1
                    continue
                if ch == "\n":
                    pos += 1
                    if depth == 0:
                        break
                    continue
                if ch == "#" and (pos == 0 or text[pos - 1] in " \t\n"):
                    e = text.find("\n", pos)
                    pos = n if e < 0 else e
                    continue
                m = self.token.match(text, pos)
                kind = m.lastgroup if m else None
                if kind in ("DASH", "Q", "BLOCK") and depth:
                    kind = None
                if kind == "DASH":
                    if not first:
                        return [*out, (pos, ERROR)]
                    out.append((pos, c["DASH"]))
                    pos += 1
                    k = pos
                    while k < n and text[k] in " \t":
                        k += 1
                    if k < n and text[k] not in "\r\n#":
                        stack.append(k - start)
                        out.append((k, c["IND"]))
                    pos = k
                    continue
                if kind == "Q":
                    return [*out, (pos, ERROR)]  # explicit keys are not read
                if kind == "BLOCK":
                    out.append((pos, c["BLOCK"]))
                    pos = m.end()
                    pos = text.find("\n", pos)
                    pos = n if pos < 0 else pos + 1
                    parent = stack[-1] if len(out) > 1 and out[-2][1] == c["COLON"] or len(stack) > 1 and out[-2][1] != c["IND"] else (stack[-2] if len(stack) > 1 else -1)
                    while pos < n:
                        e = text.find("\n", pos)
                        e = n if e < 0 else e
                        x = text[pos:e].rstrip("\r")
                        if x.strip() and len(x) - len(x.lstrip(" ")) <= parent:
                            break
                        pos = e + 1
                    break
                first = False
                if kind in ("DQ", "SQ", "ANCHOR", "ALIAS", "TAG", "COLON"):
                    if kind == "DQ" and _YAML_ESCAPE.search(m[0]):
                        return [*out, (pos, ERROR)]
                    out.append((pos, c[kind]))
                    if kind in ("ANCHOR", "TAG", "COLON"):
                        first = False
                    pos = m.end()
                    if depth == 0 and kind in ("DQ", "SQ") and "\n" in m[0]:
                        start = text.rfind("\n", 0, pos) + 1
                    continue
                if kind == "FC" and depth and out[-1][1] in (c["DQ"], c["SQ"], c["]"], c["}"]):
                    out.append((pos, c["COLON"]))
                    pos += 1
                    continue
                if kind == "FC" and depth and text[pos + 1 : pos + 2] in (",", "]", "}", "["):
                    out.append((pos, c["COLON"]))
                    pos += 1
                    continue
                if kind == "B" and (depth or ch in "[{"):
                    depth += 1 if ch in "[{" else -1 if ch in "]}" else 0
                    out.append((pos, c[ch]))
                    pos += 1
                    continue
                p = (self.flow_plain if depth else self.plain).match(text, pos)
                if not p:
                    return [*out, (pos, ERROR)]
                out.append((pos, c["PLAIN"]))
                pos = p.end()
            if depth:
                return [*out, (n, ERROR)]
            out.append((min(pos, n), c["SEP"]))
        out += [(n, c["DED"])] * (len(stack) - 1)
        return out

    def stream(self, text: str) -> str:
        return "".join(x for _, x in self.tokens(text.removeprefix("\ufeff")))

    def offset(self, text: str, i: int) -> int:
        t = self.tokens(text.removeprefix("\ufeff"))
        return t[i][0] if i < len(t) else len(text)


_YAML_ESCAPE = re.compile(r'\\(?![0abt\tnvfre "/\\N_LP\nxuU\r])')

_LANGUAGES = {
    "json": Json, "java": Java, "go": Go, "python": Python, "hcl": Hcl, "bash": Bash, "yaml": Yaml,
    "javascript": lambda: EcmaScript(False), "typescript": lambda: EcmaScript(True),
}
LANGUAGES = tuple(_LANGUAGES)


@functools.lru_cache(maxsize=None)
def language(name: str):
    return _LANGUAGES[name]()


def valid(text: str, name: str) -> bool:
    lang = language(name)
    if name != "json":
        text = text.removeprefix("\ufeff")
    return lang.parser.accepts(lang.stream(text))


def first_error(text: str, name: str) -> tuple[int, int] | None:
    """(line, column), from 1, of the first token with which the text is no beginning of a valid source; None if valid."""
    lang = language(name)
    s = lang.stream(text)
    if lang.parser.accepts(s):
        return None
    at = lang.offset(text, lang.parser.first_error(s)) if s != ERROR else len(text)
    return text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)


def parse_flags(files: DataFrame, errors: bool = False) -> DataFrame:
    """(file_id, project_path, language, valid[, error_line, error_column]) of each file in one of the bundled languages.

    The content is read by the language's lexer and its whole token stream is parsed by the bundled grammar; what other
    parsers reported is not used. With ``errors``, the place of the first token at which the file is no beginning of a
    valid source is looked up for the invalid ones (lines and columns from 1).

    Null and blank content, and null or other languages, give no row. Repeated payloads give repeated rows. Lexical errors
    (an unterminated text, a stray character) are errors at their place. An empty input gives an empty result; extra
    columns are ignored. No shuffle.
    """
    src = files.where(F.col("language").isin(*LANGUAGES) & F.col("content").isNotNull() & F.col("content").rlike(r"\S"))
    src = src.select("file_id", "project_path", "language", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, lines, columns = [], [], []
            for name, text in zip(b.column("language").to_pylist(), b.column("content").to_pylist()):
                v = valid(text, name)
                ok.append(v)
                if errors:
                    at = (None, None) if v else first_error(text, name) or (None, None)
                    lines.append(at[0])
                    columns.append(at[1])
            cols = [*b.columns[:3], pa.array(ok, pa.bool_())]
            names = ["file_id", "project_path", "language", "valid"]
            if errors:
                cols += [pa.array(lines, pa.int32()), pa.array(columns, pa.int32())]
                names += ["error_line", "error_column"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = files.schema["file_id"].dataType.simpleString()
    return spread(src).mapInArrow(run, f"file_id {kind}, project_path string, language string, valid boolean" + ", error_line int, error_column int" * errors)


def invalid_rates(flags: DataFrame) -> DataFrame:
    """(project_path, language, files, invalid, rate) over distinct files; each group has at least one file."""
    once = flags.groupBy("project_path", "language", "file_id").agg(F.min("valid").alias("valid"))
    bad = F.count_if(~F.col("valid"))
    return once.groupBy("project_path", "language").agg(F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("rate"))
