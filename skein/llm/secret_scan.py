"""Secret scan by assignment-aware lexing.

Around every ``=`` or ``:`` the scanner reads a target name on the left and a literal,
a bare value or a reference to another name on the right (shell, Python, YAML, JSON,
INI, JavaScript and Go forms). A type between name and mark (``name: type =``, Go's
``name type =``) is no target; string prefixes and triple quotes belong to a literal;
literals joined by ``+`` or standing side by side are one value; a YAML block (``name: |``)
is the lines that are indented deeper; the text of an XML element has the element's name.
A comparison (``name == "literal"``) gives its literal to the name as an assignment does; of
a credential with its scheme (``Bearer ...``) only the credential counts; a template that is
filled from variables needs six characters of its own; a bare value ends at "&". When all assignments are known, references are followed (constant propagation) to the
last assignment of that name before them, or the first one after them, so a literal
gets the names of all targets that it reaches. A reference that leads to no literal is
never reported: variables ($NAME), calls, attributes, and bare names where code would
have a name. A bare word is a literal if letters and digits mix in it, or where
configuration has values (``NAME=word``, ``name: word`` at the end of a line). Its score is
the sensitivity of the most sensitive of these names times the plausibility of the literal
(length, character variety, no placeholder); literals of ``min_score`` or more are reported
as kind ``lexed``. Three base kinds are always reported beside them: ``assign``,
``access`` and ``hex``. Spans count code points, ends are exclusive.

Defined results: null or empty text has no spans; equal spans of different kinds are
all listed, in the order of KINDS; repeated rows each get their own result; an empty table
gives no rows; very long texts, lines and names are lexed whole, in time and memory that
grow as their length (a type, or a Go declaration, takes 400 characters at most).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame

from skein.llm.common import change_rows, map_texts

# The kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "lexed")

# The base patterns.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer characters can't match at any of its places
_HINTS = ("passw", "secret", "token", "apikey", "api_key")

# Name parts that mark a sensitive target, with their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signingkey": 1.0,
    "clientsecret": 1.0, "auth": 0.6, "authorization": 0.9, "bearer": 0.8, "pass": 0.7, "dsn": 0.6,
}
# Values that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "example", "password", "secret", "none", "null", "true", "false", "undefined", "todo", "xxxxxx", "your_token_here", "placeholder", "dummy"}

_MARK = re.compile(r"[!=]==?|:=|=>|[=:]")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_PREFIX = r"""(?:[rRbBuUfFtT]{1,2}|[@$]{1,2}|[LN]|String\.raw)(?=["'`])"""
_QUOTED = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"""
#: A bare value: "&" ends it, as in k=v&k=v, and "=" stands at its end only.
_BARE = r"[A-Za-z0-9_./+$@!%^*~\-]+(?:={1,2}(?![A-Za-z0-9_./+$@!%^*~\-=\"'`{(\[]))?"
_VALUE = re.compile(rf"""[ \t]*(?:(?:{_PREFIX})?({_QUOTED})|(\$\{{?[A-Za-z_][A-Za-z0-9_]*\}}?|\$\(|%[A-Za-z_][A-Za-z0-9_]*%)|({_BARE}))""")
_MORE = re.compile(rf"""[ \t]*(?:\+[ \t]*)?(?:\\?\n[ \t]*)?(?:\+[ \t]*)?(?:{_PREFIX})?({_QUOTED})""")
# The schemes that stand before a credential.
_SCHEME = re.compile(r"(?:Bearer|Basic|Token|Digest)[ \t]+([A-Za-z0-9_./+~\-]{6,}={0,2})", re.IGNORECASE)
_FILLED = re.compile(r"\$?\{[^{}]*\}")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_PATH = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[+-]?[ \t]*\n")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*)(?:[ \t\n][^<>]*)?>([^<>]+)</")
# A type: names with dots, brackets of types, alternatives; its words are no targets.
_ONE_TYPE = r"""["']?[*&?]*(?:\[[0-9]*\])*[*]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[^=:()\n]*\]|<[^=:()\n]*>)?["']?\??"""
_TYPE = rf"({_ONE_TYPE}(?:[ \t]*\|[ \t]*{_ONE_TYPE})*)"
_TYPE_ONLY = re.compile(rf"[ \t]*{_TYPE}[ \t]*")
_GO_TYPED = re.compile(rf"[ \t]*(?:(var|const)[ \t]+)?([A-Za-z_][A-Za-z0-9_]*)[ \t]+{_TYPE}[ \t]*")
#: Characters that a type, or a Go declaration, takes at most.
LONGEST_TYPE = 400
_BRANCH = re.compile(r"(?:^|[^A-Za-z0-9_])(?:if|elif|while|and|or|not|in|is|case|when)[ \t]+$")
# Types that are written small.
TYPES = {
    "str", "string", "bytes", "bytearray", "byte", "char", "text", "rune", "varchar", "int", "uint", "float", "double", "number", "bool",
    "boolean", "object", "any", "unknown", "error", "list", "dict", "tuple", "set", "map", "none", "null", "undefined",
}
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    """0 to 1: how sensitive a target name is, by its parts and pairs of parts."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs, "".join(parts)]), default=0.0)


def plausibility(literal: str) -> float:
    """0 to 1: how much a literal looks like a secret value."""
    n = len(literal)
    if n < 6 or literal.lower() in PLACEHOLDERS or len(set(literal)) < 4:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    mixed = any(c.isdigit() for c in literal) + any(c.isalpha() for c in literal)
    return min(1.0, 0.35 + 0.15 * entropy + 0.1 * (mixed == 2))


def is_type(written: str) -> bool:
    """Whether a word or an expression in a type's place is a type: a small type word, a
    name in capital letters and small ones, or brackets, pointers or alternatives."""
    word = written.strip("\"'?")
    last = word.rpartition(".")[2]
    return not re.fullmatch(r"[A-Za-z0-9_.]+", word) or last.lower() in TYPES or last[:1].isupper() and not last.isupper()


def name_before(text: str, end: int, begin: int) -> tuple[str, int] | None:
    """(name, start) of the name that ends before ``end``, behind blanks, a bracket and a
    quote, and doesn't reach before ``begin``."""
    at = end
    while at > begin and text[at - 1] in " \t":
        at -= 1
    if at > begin and text[at - 1] == "]":
        at -= 1
    if at > begin and text[at - 1] in "\"'":
        at -= 1
    stop = at
    while at > begin and text[at - 1] in _NAME_CHARS:
        at -= 1
    while at < stop and not (text[at].isalpha() or text[at] == "_"):
        at += 1
    return (text[at:stop], at) if at < stop else None


def typed_target(text: str, begin: int, end: int) -> tuple[str, int] | None:
    """The name that a type follows at the end of text[begin:end] (part of one line), and
    the place of the colon between them, -1 if there is none."""
    colon = text.rfind(":", begin, end)
    if colon >= 0 and end - colon <= LONGEST_TYPE:
        got = _TYPE_ONLY.fullmatch(text, colon + 1, end)
        name = name_before(text, colon - (text[colon - 1 : colon] in ("?", "!")), begin)
        if got and name and is_type(got.group(1)) and not _BRANCH.search(text, max(begin, name[1] - 8), name[1]):
            return name[0], colon
    cut = max(text.rfind(c, begin, end) for c in ";({")
    start = max(begin, cut + 1)
    got = _GO_TYPED.fullmatch(text, start, end) if end - start <= LONGEST_TYPE else None
    if got and got.group(2).lower() not in TYPES and (got.group(1) == "var" or is_type(got.group(3))):
        if got.group(1) or got.group(3).lower() in TYPES or not re.match(r"[A-Za-z]", got.group(3)):
            return got.group(2), -1
    return None


def credential(word: str) -> bool:
    """Whether a bare word behind a scheme is no word of prose."""
    return len(word) >= 24 or any(c.isdigit() for c in word) and any(c.isalpha() for c in word)


class Assignment(NamedTuple):
    name: str
    start: int
    end: int
    literal: str  # "" for what isn't a literal
    refers: str | None  # the name that the value refers to


def value_after(text: str, mark: re.Match) -> tuple[int, int, str, str | None] | None:
    """(start, end, literal, name referred to) of the value after a mark."""
    at = mark.end()
    got = _VALUE.match(text, at)
    if not got:
        return None
    if got.group(1):
        start, end = got.start(1) + 1, got.end(1) - 1
        quote = text[start - 1]
        if start == end and text.startswith(quote * 2, end):  # triple quotes
            stop = text.find(quote * 3, end + 2)
            if stop >= 0:
                return start + 2, stop, text[start + 2 : stop], None
        parts, more = [text[start:end]], _MORE.match(text, got.end(1))
        while more and ("+" in text[got.end(1) : more.start(1)] or "\n" not in text[got.end(1) : more.start(1)]):
            parts.append(more.group(1)[1:-1])
            end, got = more.end(1) - 1, more
            more = _MORE.match(text, more.end(1))
        literal = "".join(parts)
        if scheme := _SCHEME.fullmatch(literal) if len(parts) == 1 else None:
            return start + scheme.start(1), end, scheme.group(1), None
        filled = quote == "`" or "f" in text[mark.end() : start - 1].lower()
        return start, end, literal if not filled or len(_FILLED.sub("", literal)) >= 6 else "", None
    if got.group(2):
        return *got.span(2), "", got.group(2).strip("${}%(") or None
    start, end = got.span(3)
    if (scheme := _SCHEME.match(text, start)) and credential(scheme.group(1)):
        return *scheme.span(1), scheme.group(1), None
    value, after = got.group(3), text[end : end + 1]
    if _PATH.fullmatch(value) or after in ("(", "[") and value[:1].isalpha():
        return start, end, "", value
    if not _WORD.fullmatch(value):
        return start, end, value, None
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    close = mark.group() == "=" and start == at and text[mark.start() - 1 : mark.start()] not in (" ", "\t")
    config = after in ("", "\n", "\r") and (close or mark.group() == ":")
    return start, end, value if mixed or config else "", value


def block_after(text: str, at: int, line: int) -> tuple[int, int] | None:
    """The span of a YAML block behind a mark: the lines indented deeper than that at ``line``."""
    got = _BLOCK.match(text, at)
    if not got:
        return None
    depth = len(text[line:at]) - len(text[line:at].lstrip(" "))
    start, end, place = None, got.end(), got.end()
    while place < len(text):
        stop = text.find("\n", place)
        stop = len(text) if stop < 0 else stop
        row = text[place:stop]
        if row.strip():
            if len(row) - len(row.lstrip(" ")) <= depth:
                break
            start = place + len(row) - len(row.lstrip(" ")) if start is None else start
            end = place + len(row.rstrip())
        place = stop + 1
    return (start, end) if start is not None else None


def lex(text: str) -> list[Assignment]:
    """The assignments of a text, in the order of their marks."""
    found: dict[int, list[Assignment]] = {}
    colons: dict[int, int] = {}  # start of the value: place of the colon
    line = last = seen = 0  # starts of the line, and of what stands behind the last "=" and the last mark
    for mark in _MARK.finditer(text):
        line = max(line, text.rfind("\n", seen, mark.start()) + 1)
        seen = mark.end()
        begin = max(line, last)
        if mark.group() != ":":
            last = mark.end()
        near = name_before(text, mark.start(), begin)
        typed = typed_target(text, begin, mark.start()) if mark.group() == "=" else None
        if not near and not typed:
            continue
        block = block_after(text, mark.end(), line) if mark.group() == ":" else None
        value = (*block, text[block[0] : block[1]], None) if block else value_after(text, mark)
        if not value:
            continue
        if mark.group() == ":":
            colons[value[0]] = mark.start()
        elif near:  # in "if x: name = ..." the name isn't the value of x
            found.pop(colons.get(near[1], -1), None)
        names = [near[0]] if near else []
        if typed:  # a type whose name is sensitive may be a key after all
            names = [typed[0], *(n for n in names if sensitivity(n))]
            found.pop(typed[1], None)
        found[mark.start()] = [Assignment(n, *value) for n in names]
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            if text.startswith(m.group(1) + ">", m.end()) and (inner := m.group(2).strip()):
                start = m.start(2) + m.group(2).index(inner)
                found[m.start()] = [Assignment(m.group(1), start, start + len(inner), inner, None)]
    return [a for place in sorted(found) for a in found[place]]


def lexed_spans(text: str, min_score: float) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name."""
    every = lex(text)
    places: dict[str, list[int]] = {}
    for k, a in enumerate(every):
        places.setdefault(a.name, []).append(k)
    ends: dict[int, int] = {}
    best: dict[int, float] = {}
    for k, a in enumerate(every):
        at, way = k, {k: None}
        while at not in ends and every[at].refers in places:
            of = places[every[at].refers]
            j = bisect_left(of, at)
            after = j + (j < len(of) and of[j] == at)
            to = of[j - 1] if j else of[after] if after < len(of) else at
            if to in way:  # names in a ring
                break
            at = to
            way[at] = None
        at = ends.get(at, at)
        ends.update(dict.fromkeys(way, at))
        best[at] = max(best.get(at, 0.0), sensitivity(a.name))
    return sorted({every[k][1:3] for k, v in best.items() if v and every[k].literal and v * plausibility(every[k].literal) >= min_score})


def has_values(text: str) -> bool:
    return "=" in text or ":" in text or "</" in text


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds."""
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(
    docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed."""

    def make():
        def one(text: str) -> tuple:
            base = base_spans(text)
            more = [(s, 3, e) for s, e in lexed_spans(text, min_score)] if has_values(text) else []
            kinds = Counter(k for _, k, _ in base)
            return kinds[0], kinds[1], kinds[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)

        def call(ids: list, texts: list[str]) -> dict[str, list]:
            cols = list(zip(*map(one, texts))) or [()] * 6
            out = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed")
            return {"doc_id": ids, **{n: list(c) for n, c in zip(out, cols)}}

        return call

    return map_texts(
        docs, make,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long",
        id_col, text_col, as_bytes=False,
    )


def redact(text: str, min_score: float, mask: str) -> str | None:
    """The text with every found span replaced by the mask; None if there is none."""
    spans = [(s, e) for s, _, e in base_spans(text)]
    if has_values(text):
        spans += lexed_spans(text, min_score)
    if not spans:
        return None
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            if start >= at:
                out += [text[at:start], mask]
            at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, min_score: float = 0.5, mask: str = "[secret]", text_col: str = "text") -> DataFrame:
    """docs with secrets masked in the text column; all columns and rows stay."""
    return change_rows(
        docs, lambda: lambda texts: (None, [redact(t, min_score, mask) for t in texts]), text_col
    )
