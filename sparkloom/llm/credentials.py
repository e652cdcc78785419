"""Credentials embedded in code, configuration and prose: finding and redacting them."""

from __future__ import annotations

import base64
import binascii
import bisect
import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

REDACTED = "REDACTED"

# Words that make an identifier a credential's name, in several languages.
_SECRET = frozenset(
    "password passwd pwd pass passphrase passcode passwort kennwort contrasena contrase\u00f1a clave motdepasse mdp senha parola "
    "wachtwoord haslo secret secrets token tok apikey auth authorization bearer basic credential credentials creds "
    "privatekey accesskey secretkey signer pin otp jwt cred pw passkey".split()
)
# Words whose literal is a password, however weak, unless it is a placeholder.
_PASSWORD = frozenset("password passwd pwd pw passphrase passcode passwort kennwort contrasena contrase\u00f1a clave motdepasse mdp senha parola wachtwoord haslo".split())
# Words that a message about a password has, and a passphrase hardly.
_FUNCTION_WORDS = frozenset("a an and are as at be by can choose do does empty enter field for forgot from has have if in incorrect invalid is it its may must new no not of old on one or please required reset same should that the this to too use was when will with wrong you your".split())
# Words that make "<word>_key" a secret, and those that make it something else.
_KEY_OF = frozenset("api secret access private signing sign encryption encrypt auth master service client payments payment billing remote deploy license account storage webhook session cookie hmac shared server admin app consumer indexer".split())
_NOT_KEY = frozenset("public foreign sort primary partition authorized unique cache row object map group lookup index hash natural surrogate composite candidate".split())
# Last words of identifiers that name something about a credential, not the credential.
_ABOUT = frozenset(
    "label prompt field name names header headers version digest hash id ids path file filename url uri endpoint count type kind length len size limit ttl "
    "expiry expires expiration age hint placeholder message error text title description regex pattern param column policy prefix suffix index env var "
    "variable min max location ref reference provider source format scheme realm algorithm alg fingerprint thumbprint checksum scope input form page "
    "integrity sri icon logo pixel image commit revision sha etag public".split()
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[*x.\-_#?\u2022+0]+|(?:my|the|some|a|test|dummy|fake|sample|default|old|new|user|admin|db)?[_\- ]?(?:secret|password|passwd|pass|passwort|contrasena|token|key|apikey|api[_-]key|value|string|credentials?)"
    r"|none|null|nil|true|false|todo|fixme|tbd|undefined|redacted|removed|hidden|masked|unset|empty|n/?a|foo|bar|baz|foobar|test|testing|example|username|user|admin|root|guest|anonymous)$"
    r"|change[_\- ]?(?:me|this|it)|replace[_\- ]?(?:me|this|with)|your[_\- ]|\byours\b|goes[_\- ]?here|[_\- ]here$|insert[_\- ]|placeholder|dummy|^example|example$|fill[_\- ]?(?:me|in)|to[_\- ]?be[_\- ]|not[_\- ]?(?:a[_\- ])?real|"
    r"^<.*>$|\$\{|\$\(|^\$[A-Za-z_]|\{\{|^%(?:[sdvq]$|\(\w+\)[sd]$|\{|\w+%$)|^\[.*\]$|^@|^#\{|^env[.:/(]|^vault|/path/|^ssm:|^arn:|^secretsmanager|^keyvault|^op://|^sops|^enc\[|^x-[a-z-]+$"
)
_UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}?$")
_HEX = re.compile(r"(?i)^(?:0x)?[0-9a-f]{16,}$")
_RANDOM = re.compile(r"^[A-Za-z0-9_\-+/=.~]{20,}$")
_B64 = re.compile(r"^[A-Za-z0-9+/_\-]{8,}={0,2}$")
_NOT_SECRET_VALUE = re.compile(r"^(?:sha\d+[-:]|data:|ssh-|ecdsa-|AAAA|https?://[^@]*$|pk_|pub-|urn:|/[a-z0-9_.\-]+(?:/|$)|\.{1,2}/)|-----BEGIN (?:CERTIFICATE|PUBLIC|RSA PUBLIC)")

# literals: a prefix (Python), then a quoted text with escapes; at least one character inside
_STR = r"""(?:[rRbBuU]{0,2}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|`[^`]*`)"""
_JOIN = r"(?:[ \t]*(?:\\?\n[ \t]*)?(?:\+|\.\.|\|\||<>|&|\.)?[ \t]*(?:\\?\n[ \t]*)?)"
# one token: a comment, a literal, a word (with an apostrophe in it) or what lies between
_TOKEN = re.compile(
    r"""(?P<comment>(?<![:\w"'`/])//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/|(?:(?<=[\s;])|\A)\#(?![!{\[])[^\n]*+|(?:(?<=\s)|\A)--[ ][^\n]*+|<!--(?:[^-]|-(?!->))*+-->)"""
    r"""|(?P<long>[rRbBuU]{0,2}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''))|(?P<literal>""" + _STR + r""")"""
    r"""|[A-Za-z_]\w*+(?:'(?:t|s|re|ve|ll|d|m)\b(?!'))?|[^"'`/\#A-Za-z_\-<]++|.""",
    re.S,
)
# directly before a literal: the operator that gives it to a name, and an opening bracket
_GIVEN = re.compile(r"(?:=>|[=:,])[ \t]*(?:\([ \t]*\n?[ \t]*)?\Z")
# directly after it: the literals joined to it
_JOINED = re.compile(r"(?:" + _JOIN + _STR + r")*")
# name, closing quote or bracket, type annotation, first part of the operator
_NAME = re.compile(r"""([A-Za-z_À-ɏ][\w.\-À-ɏ]*)["'`\]]{0,2}[ \t]*(?::[ \t]*(?:\*|&)?[A-Za-z_][\w.<>\[\]]*\??[ \t]*|[ \t]string[ \t]*)?(?::|\?\?|\|\|)?\Z""")
_LIT = re.compile(_STR)
# the words of names that take the name of a credential to look it up, not the credential
_LOOKUP = frozenset("get fetch read load lookup find resolve retrieve require env getenv".split())
_CALLEE = re.compile(r"(?<!\w)(?<!\w\.)([A-Za-z_\u00c0-\u024f][\w.]*+)\(")
# within the arguments of a call: literals with those joined to them, callees, brackets, ends of arguments
_ARGUMENT = re.compile(r"(?P<lit>" + _STR + r")(?P<rest>(?:" + _JOIN + _STR + r")*)|(?P<callee>[A-Za-z_\u00c0-\u024f][\w.]*+)?(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<comma>,)|(?P<space>\s+)|[\w.]+|.", re.S)
# what makes a literal the key of a pair, or shows that the end of the text cuts its expression short
_NOT_WHOLE = re.compile(r"\s*+(?:[+.\\]?\s*\Z|:|=>)")
# unquoted: KEY=value, key: value, --key value
_BARE = re.compile(r"""(?m)^[ \t]*(?:[-*>$#]+[ \t]+)?(?:(?:export|set|setenv|ENV|ARG|declare|local|readonly|var|-e)[ \t]+)*([A-Za-z_][\w.\-]*)(?:[ \t]?=|:[ \t]+)[ \t]*(?![ \t"'`=:(\[{|>&!])([^\s"'`][^\n"'`]*?)[ \t\r]*$""")
_FLAG = re.compile(r"""(?<![\w-])--?([A-Za-z_][\w.\-]*)(?:=|[ \t]+)(?!-)("[^"\n]+"|'[^'\n]+'|[^\s"'`][^\s"'`]*(?:;User Id=[^\n"'`]*?(?=[ \t\r]*$))?)""")
_BLOCK_SCALAR = re.compile(r"(?m)^([ \t]*)(?:- )?([A-Za-z_][\w.\-]*):[ \t]*[|>][-+\d]*[ \t]*\r?\n((?:\1[ \t]+\S[^\n]*(?:\n|$)|[ \t]*\r?\n)+)")
_FORMATS = re.compile(
    r"(?P<aws>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)|(?P<gh>\bgh[pousr]_[A-Za-z0-9]{30,})|(?P<slack>\bxox[abeoprs]-[A-Za-z0-9-]{20,})|(?P<stripe>\b[sr]k_(?:live|prod)_[A-Za-z0-9]{16,})"
    r"|(?P<sxk>\bs[xk]k?_[0-9a-f]{32,})|(?P<jwt>\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})"
    r"|(?P<pem>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"
    r"|(?P<url>(?<=[a-z0-9+.\-])://[^\s/:@\"'`]*:(?P<urlpw>[^\s/@\"'`]+)@)"
    r"|(?P<conn>(?<=[;&?\"'`])[ \t]*(?i:password|pwd)=(?P<connpw>[^;&\s\"'`]{4,}))"
    r"|(?P<basic>\bBasic[ \t]+(?P<basicpw>[A-Za-z0-9+/]{8,}={0,2}))"
    r"|(?P<bearer>\bBearer[ \t]+(?P<bearerpw>[A-Za-z0-9_\-.~+/]{20,}=*))"
    r"|(?P<curl>(?:[ \t]-u|--user)[ \t=]*['\"]?[\w.@\-]+:(?P<curlpw>[^\s'\"]{4,}))",
    re.ASCII,
)
#: Substrings of the lower-cased text without which the scan for formats finds nothing.
_FORMAT_HINTS = ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "k_live_", "k_prod_", "sx_", "sk_", "sxk_", "skk_", "eyj", "private key", "password=", "pwd=", "basic", "bearer", " -u", "\t-u", "--user")
#: The words at which a note begins. Lower-cased ASCII text without any has none; other text is always scanned, as case-
#: insensitive patterns match some letters that lower-casing leaves.
_NOTE_WORDS = ("log in", "log-in", "login", "sign in", "sign-in", "signin", "psql", "mysql", "sso", "vpn", "password", "passwort", "credentials", "credential", "creds", "account", "user", "fallback")
# a line that speaks of logging in
_LOGIN_LINE = re.compile(r"(?i)\b(?:" + "|".join(_NOTE_WORDS) + r")\b(?:(?!--)[^\n\"'`])*")
# within it: a user, what separates the two, the password
_USER_AND = re.compile(r"(?i)(?<![\w.@\-])[a-z][\w.@\-]{2,31}(?:[ \t]+/[ \t]+|[ \t]*:[ \t]*|,[ \t]+|[ \t]+with(?:[ \t]+password)?[ \t]+|[ \t]+password(?:[ \t]+is)?:?[ \t]+|[ \t]+pw:?[ \t]+)(?=([^\s\"'`]{6,}?)[,.;)]*(?:[ \t\r,]|\Z))")
# the beginning of a URL's scheme, which is read backwards from its "://" so that long values take linear time
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_SCHEME_START = re.compile(r"\b[a-z]", re.ASCII)
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ESCAPED_NL = re.compile(r"\\n|\\r")


def _words_of(name: str) -> list[str]:
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name).lower()
    words = [w for w in re.split(r"[_.\-]+", name) if w and not w.isdigit()]
    return [re.sub(r"\d+$", "", w) or w for w in words]


@functools.lru_cache(maxsize=200_000)
def takes_credential(callee: str) -> bool:
    """Whether a call's arguments go to a credential's name; those of a lookup are names of credentials."""
    return name_class(callee) == 2 and _LOOKUP.isdisjoint(_words_of(callee.rsplit(".", 1)[-1]))


@functools.lru_cache(maxsize=200_000)
def name_class(name: str) -> int:
    """2: the name of a credential; 1: any other; 0: something about a credential, or a digest, an id, a public key."""
    words = _words_of(name)
    if words and words[-1] in ("b", "base", "encoded", "enc", "raw", "plain", "prod", "dev", "data", "str", "string", "value", "val") and len(words) > 1:
        words = words[:-1]
    if not words:
        return 1
    last = words[-1]
    joined = "_".join(words)
    if joined in ("access_key_id", "aws_access_key_id") or joined.endswith("_access_key_id"):
        return 1  # decided by format
    if last in _ABOUT:
        return 0
    if last in ("key", "keys"):
        if len(words) > 1 and words[-2] in _NOT_KEY:
            return 0
        return 2 if len(words) > 1 and words[-2] in _KEY_OF else 1
    if last == "pw" and re.search(r"\d$", name):
        return 1  # a short name that tools make
    if last in _SECRET or "mot_de_passe" in joined or joined.endswith("de_passe"):
        return 2
    return 1


def _classes(v: str) -> int:
    return bool(re.search("[a-z]", v)) + bool(re.search("[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^\w\s/.:\-]", v))


# words joined by marks, with digits at the end: a passphrase, where a name or a pair says that it is one
_PASSPHRASE = re.compile(r"^[a-z]{3,}(?:[-_.][a-z]{3,})+[-_.]?\d{1,6}$")


def strong(v: str) -> bool:
    """Whether a text given to a credential's name is a value: not a placeholder, word, phrase, id or reference."""
    if len(v) < 6 or re.search(r"\s", v) or _PLACEHOLDER.search(v) or _UUID.match(v) or _NOT_SECRET_VALUE.search(v) or v.isdigit():
        return False
    if re.search(r"[{}()<>]|\$[A-Z_{]", v):
        return False
    n = _classes(v)
    if n >= 3 or _PASSPHRASE.match(v) or _HEX.match(v):
        return True
    digit = re.search(r"\d", v) is not None
    if n == 2 and digit and len(v) >= 8 and "/" not in v and not re.match(r"^[A-Za-z]+(?:[_\-.:][A-Za-z]+)*[_\-.:]?\d{1,5}$", v):
        return True
    return n == 2 and not digit and len(v) >= 10 and re.search(r"[a-z]", v) is not None and (re.search(r"[A-Z]", v) is None or len(re.findall(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[A-Z](?=[a-z])", v)) >= 2) and not re.match(r"^[A-Za-z]+(?:[_\-.:/][A-Za-z]+)*$", v)


def password(v: str) -> bool:
    """Whether a text given to a password's own name is one: any but placeholders, references and messages, weak words too;
    with spaces only plain words of a passphrase."""
    if strong(v):
        return True
    if len(v) < 6 or _PLACEHOLDER.search(v) or _UUID.match(v) or _NOT_SECRET_VALUE.search(v) or re.search(r"[{}<>]|\$[A-Z_{(]|^\$", v):
        return False
    if re.search(r"\s", v):
        words = v.split(" ")
        return len(words) >= 4 and all(w.isalpha() and w.islower() for w in words) and _FUNCTION_WORDS.isdisjoint(words)
    return re.fullmatch(r"[^\s()\[\];,]+", v) is not None and re.fullmatch(r"[a-z]+([._/][a-z]+)+", v, re.I) is None and _SECRET.isdisjoint(_words_of(v))


def credential(name: str, v: str) -> bool:
    """Whether a literal is the value of the credential that it is given to by name."""
    return strong(v) or _strong_b64(v) or _is_password(name) and password(v)


@functools.lru_cache(maxsize=200_000)
def _is_password(name: str) -> bool:
    words = [w for w in _words_of(name.rsplit(".", 1)[-1]) if w not in ("value", "val", "str", "string", "raw", "plain", "prod", "dev")]
    return bool(words) and name_class(name) == 2 and (words[-1] in _PASSWORD or words[-1] == "pass" and len(words) > 1)


def random_text(v: str) -> bool:
    """Whether a text looks drawn at random: long, upper and lower case and digits well mixed, no id or digest."""
    if not _RANDOM.match(v) or _UUID.match(v) or _HEX.match(v) or _NOT_SECRET_VALUE.search(v) or _PLACEHOLDER.search(v) or v.count("/") > 3 or v.count(".") > 1:
        return False
    if not (re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search(r"\d", v)):
        return False
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in v]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) >= 0.4 * len(v)


def _decoded(v: str) -> str:
    try:
        return base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return ""


def _secret_part(v: str) -> tuple[int, int] | None:
    """The span of the credential inside a literal of a known format, if it is one."""
    for m in _FORMATS.finditer(v):
        span = _span_of(m, v)
        if span:
            return span
    return None


def _span_of(m: re.Match, text: str) -> tuple[int, int] | None:
    kind = next(k for k in ("aws", "gh", "slack", "stripe", "sxk", "jwt", "pem", "url", "conn", "basic", "bearer", "curl") if m[k] is not None)
    if kind == "pem":
        e = _PEM_END.search(text, m.end())
        other = text.find("-----BEGIN", m.end())
        return (m.start(), e.end()) if e and not m.end() < other < e.start() else None
    if kind == "url":
        a = m.start()
        while a and text[a - 1] in _SCHEME:
            a -= 1
        if not _SCHEME_START.search(text, a, m.start()):
            return None
    g = {"url": "urlpw", "conn": "connpw", "basic": "basicpw", "bearer": "bearerpw", "curl": "curlpw"}.get(kind, kind)
    s = m[g]
    if kind in ("url", "conn", "curl") and (_PLACEHOLDER.search(s) or re.search(r"[{}<>]|^\$", s)):
        return None
    if kind == "basic" and ":" not in _decoded(s):
        return None
    return m.span(g)


def find(text: str) -> list[list[tuple[int, int]]]:
    """The credentials of a text, in order of position: each a list of (start, end), more than one if its value is put
    together from several literals. Each span is the value itself, inside its delimiters."""
    found: list[list[tuple[int, int]]] = []

    def given(at: int) -> re.Match | None:
        """The operator directly before a literal, looked for over the space and the bracket between."""
        i = at
        while i > 0 and text[i - 1] in " \t\n(":
            i -= 1
        return _GIVEN.search(text, max(0, i - 2), at)

    def literal(start: int, end: int) -> int:
        """Judges a literal with those joined to it; where they end."""
        op = given(start)
        if not op:
            return end
        first, joined = text[start:end], _JOINED.match(text, end)
        rest = joined[0]
        if len(first) < 7 and not rest:
            return end
        begin = op.start()
        while begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] in "_.-\"'`] \t:?|*&<>[]"):
            begin -= 1
        n = _NAME.search(text, begin, op.start())
        if not n:
            return end
        kind = name_class(n[1])
        if not rest and (kind < 2 and len(first) < 18 or len(first) < 8 and not _is_password(n[1])):
            return end
        parts = [_inner(first, start)]
        if rest:
            parts += [_inner(x[0], end + x.start()) for x in _LIT.finditer(rest)]
        v = "".join(text[a:b] for a, b in parts)
        if not v:
            return end
        if _open_ended(text, op.start(), start, joined.end()):
            return end
        part = _secret_part(v)
        if part is None and not (kind == 2 and (credential(n[1], v) if op[0][0] != "," or n[0][-1] in "\"'`" else strong(v) or _strong_b64(v)) or kind == 1 and op[0][0] != "," and random_text(v)):
            return joined.end()
        if part is None:
            found.append(parts)
            return joined.end()
        spans, at = [], 0
        for a, b in parts:  # the part's place in the literals it lies in
            n = b - a
            s, e = max(part[0] - at, 0), min(part[1] - at, n)
            if s < e:
                spans.append((a + s, a + e))
            at += n
        found.append([(parts[0][0], parts[0][0]), *spans] if len(parts) > 1 and spans and spans[0][0] >= parts[0][1] else spans)
        return joined.end()

    def scan(start: int, end: int, depth: int = 0) -> None:
        """Reads the tokens of a stretch: literals are judged; comments and long literals may hold code again."""
        at = start
        while at < end:
            for m in _TOKEN.finditer(text, at, end):
                kind = m.lastgroup
                if kind == "literal":
                    at = literal(m.start(), m.end())
                    if "`" == text[m.end() - 1] and depth < 3 and "\n" in m[0]:
                        scan(m.start() + 1, m.end() - 1, depth + 1)
                    if at > m.end():
                        break  # past those joined to it
                elif kind == "comment":
                    scan(m.start() + 1 if m[0][0] == "#" else m.start() + 2, m.end(), depth + 1)
                elif kind == "long":
                    at = literal(m.start(), m.end()) if "\n" not in m[0] else m.end()
                    if depth < 3:
                        q = m[0].find(m[0][-3:])
                        scan(m.start() + q + 3, m.end() - 3, depth + 1)
            else:
                return

    def arguments(at: int) -> int:
        """Reads a call from its callee on, calls within it too, to its end."""
        calls: list[str | None] = []  # for each open bracket, the credential whose call it is
        begins = False
        for m in _ARGUMENT.finditer(text, at):
            kind = m.lastgroup if m["lit"] is None else "lit"
            if kind == "lit":
                parts = [_inner(m["lit"], m.start("lit"))]
                parts += [_inner(x[0], m.start("rest") + x.start()) for x in _LIT.finditer(m["rest"])]
                v = "".join(text[a:b] for a, b in parts)
                if begins and calls[-1] and not _NOT_WHOLE.match(text, m.end()) and _secret_part(v) is None and credential(calls[-1], v):
                    found.append(parts)
            elif kind == "open":
                calls.append(m["callee"] if m["open"] == "(" and m["callee"] is not None and takes_credential(m["callee"]) else None)
            elif kind == "close":
                calls.pop()
                if not calls:
                    return m.end()
            if kind != "space":
                begins = kind in ("open", "comma")
        return len(text)

    scan(0, len(text))
    at = 0
    for m in _CALLEE.finditer(text):
        if m.start() >= at and takes_credential(m[1]):
            at = arguments(m.start())
    for m in _BARE.finditer(text):
        kind = name_class(m[1])
        v = m[2].rstrip(";,") if kind else ""
        if not v:
            continue
        part = _secret_part(v)
        if part:
            found.append([(m.start(2) + part[0], m.start(2) + part[1])])
        elif kind == 2 and (strong(v) or _is_password(m[1]) and "=" in text[m.end(1) : m.start(2)] and re.search(r"\d|[A-Z].*[a-z]", v) and password(v)) or kind == 1 and "=" in text[m.end(1) : m.start(2)] and random_text(v):
            found.append([(m.start(2), m.start(2) + len(v))])
    lower = text.lower()
    if any(x in lower for x in _FORMAT_HINTS) or "://" in text and "@" in text:
        for m in _FORMATS.finditer(text):
            p = _span_of(m, text)
            if p:
                found.append([p])
    for m in _FLAG.finditer(text) if "-" in text else ():
        if name_class(m[1]) == 2:
            s, e = (m.start(2) + 1, m.end(2) - 1) if m[2][0] in "\"'" else m.span(2)
            if strong(text[s:e]):
                found.append([(s, e)])
    if not text.isascii() or any(x in lower for x in _NOTE_WORDS):
        for line in _LOGIN_LINE.finditer(text):
            for m in _USER_AND.finditer(text, line.start(), line.end()):
                if strong(m[1]) and (_classes(m[1]) >= 3 or _PASSPHRASE.match(m[1])) and "base64," not in m[1] and "//" not in m[1]:
                    found.append([m.span(1)])
                    break
    for m in _BLOCK_SCALAR.finditer(text) if "|" in text or ">" in text else ():
        v = "".join(x.strip() for x in m[3].split("\n"))
        if name_class(m[2]) == 2 and strong(v):
            found.append([(m.start(3) + x.start(), m.start(3) + x.end()) for x in re.finditer(r"\S+", m[3])])
    return _once(found)


def _inner(literal: str, at: int) -> tuple[int, int]:
    """The span of a literal's content."""
    i = 0
    while literal[i] not in "\"'`":
        i += 1
    return at + i + 1, at + len(literal) - 1


_CUT_SHORT = re.compile(r"\s*+(?:\+|\\|\.|\+ \\)?\s*+\Z")


def _open_ended(text: str, op: int, start: int, end: int) -> bool:
    """Whether the end of the text cuts short the expression of the literals from ``start`` to ``end``, given at ``op``."""
    m = _CUT_SHORT.match(text, end)
    return m is not None and (bool(m[0].strip()) or "(" in text[op:start])


def _strong_b64(v: str) -> bool:
    return _B64.match(v) is not None and len(v) >= 12 and _classes(v) >= 2 and strong(_decoded(v))


def _once(found: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Of findings that overlap, the one that begins first (of these the longest) stays."""
    found = sorted((f for f in found if f), key=lambda f: (f[0][0], -f[-1][1]))
    out: list[list[tuple[int, int]]] = []
    end = -1
    for f in found:
        if f[0][0] >= end:
            out.append(f)
            end = f[-1][1]
        elif f[0][0] == f[0][1]:
            continue
    return out


def redact(text: str) -> str:
    """The text with each credential replaced. Delimiters, line ends and everything around stay as they are: the first
    literal of a value becomes a plain word, the others become empty; in a key block each line of its body becomes one."""
    out, at = [], 0
    for spans in find(text):
        for i, (s, e) in enumerate(spans):
            if s < at or s == e:
                continue
            out.append(text[at:s])
            v = text[s:e]
            if "-----BEGIN" in v:
                out.append(_redact_block(v))
            else:
                out.append(REDACTED if i == 0 or spans[0][0] == spans[0][1] and i == 1 else "")
            at = e
    out.append(text[at:])
    return "".join(out)


def _redact_block(v: str) -> str:
    parts = re.split(r"(\r?\n[ \t]*|\\r\\n|\\n)", v)
    return "".join(p if i % 2 or not p or p.startswith("-----") else REDACTED for i, p in enumerate(parts))


def _lines_found(text: str) -> list[int]:
    spans = find(text)
    if not spans:
        return []
    ends = [m.start() for m in re.finditer("\n", text)]
    return sorted({bisect.bisect_left(ends, s[0][0]) + 1 for s in spans})


def credential_lines(records: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, line_no): one row per line on which a credential's value begins; lines count from 1 and end with ``\\n``.

    The text is read lexically, as comments, literals and code: literals (with the literals joined to them) assigned or passed to an identifier (any
    argument of a call of that name, but of lookups such as ``getPassword``), unquoted settings, flags and block scalars, and values of known formats anywhere. A value counts if its name is a
    credential's and it is no placeholder, reference, id or phrase; or if its format says so; or if it is a long random
    text. Public keys, certificates, digests and values read from an environment don't count.

    Null and empty texts give no rows; repeated rows give their lines again (use distinct); a null key is kept; extra
    columns are ignored. No shuffle.
    """
    kinds = [records.schema[k].dataType.simpleString() for k in keys]
    src = records.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(text_col).alias("_t")).where("_t is not null and _t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lines = [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                for n in _lines_found(t):
                    rows.append(i)
                    lines.append(n)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(keys))), pa.array(lines, pa.int32())], [*keys, "line_no"])

    return spread(src).mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in zip(keys, kinds)) + ", line_no int")


def redact_column(records: DataFrame, text_col: str) -> DataFrame:
    """The records with the credentials of ``text_col`` replaced; a null text stays null. No shuffle."""

    @F.pandas_udf("string")
    def cleaned(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda t: redact(t) if t else t)

    return records.withColumn(text_col, cleaned(F.col(text_col)))
