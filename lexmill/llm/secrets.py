"""Secrets by assignment-aware lexing.

One pass over a text, read as source or configuration, finds strings (quoted, raw or otherwise prefixed, triple, template),
comments, operators and elements of XML, and of these makes pairs of a name and a literal. Assignment signs are =, :, :=,
?=, += and =>; comparisons (==, ===, !=, <=, >=) and -> and :: are no assignments. The name stands left of the sign (plain,
dotted, quoted or in brackets), the literal right of it: quoted, in parts joined by +, a dot or juxtaposition, or bare up
to a delimiter. ``name: type = literal`` is one assignment to the name. Signs within a bare value start pairs of their own,
each up to the next. ``<name>literal</name>`` is a pair, and so are a key and a value given as two attributes or members
(key="name" value="literal").

A right side that is itself a name is a reference: constants are propagated along references, to the last definition
before the use that is still in scope, through any number of names. Functions and classes are scopes, by indentation, and
so is a comment, whose pairs count but define nothing outside it. A literal is scored by what its target is called and by
its own look; one that reaches the bound is reported where it stands, as kind ``literal``, unless a base span holds it
already. Names and literals may be of any length; the pass takes time in proportion to the text.

Base kinds, in order: assign, access, hex, as leftmost non-overlapping matches, failing ones dropped; spans are those of
the whole match. Defined cases: null and empty texts have no spans; texts are scanned whole; repeated rows each have
their row; extra columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.spans import Span, report

#: The base patterns, and how many characters a match (for assign its value) must have.
BASE = ("assign", "access", "hex")
PATTERNS = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: Only runs that are long enough can pass, and no shorter one can hide them: the run is maximal either way.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

#: Weights of words in a name, alone or in company.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "apikey": 3, "token": 2, "credential": 2, "credentials": 2, "bearer": 2, "auth": 1, "signature": 1}
COMPANY = {("api", "key"): 3, ("access", "key"): 3, ("private", "key"): 3, ("secret", "key"): 3, ("signing", "key"): 3, ("encryption", "key"): 3, ("account", "key"): 2}
PLACEHOLDER = re.compile(r"example|changeme|placeholder|dummy|your[_-]|<.*>|\$\{|\{\{|^(.)\1+$|^x{4,}", re.IGNORECASE)
NEED = 6

#: The characters that the lexer stops at, line ends only where there are scopes, and what it then reads.
STOP = re.compile(r"[=:\"'`#</>]")
STOP_LINES = re.compile(r"[\n=:\"'`#</>]")
TOKEN = re.compile(
    r"""(?P<line>\n[ \t]*(?=[^\s]))|(?P<compare>={2,3}|[<>]=(?!>)|<=>|::)|(?P<sign>:=|=>|[=:])|(?P<triple>\"{3}|'{3})|(?P<fence>`{3,})"""
    r"""|(?P<quote>["'`])|(?P<comment>(?<![^\s;{}()])(?:\#|//)|/\*|<!--)|(?P<close></[A-Za-z_][\w:.-]*)|(?P<open><[A-Za-z_][\w:.-]*)|(?P<angle>>)"""
)
CLOSERS = {"/*": "*/", "<!--": "-->"}
QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`", re.DOTALL)
#: A backtick opens a string over several lines only behind one of these; elsewhere it closes in its line. Three are a fence.
TEMPLATE = frozenset("=:([{,+?>")
INLINE = re.compile(r"`([^`\n]*)`")
PREFIX = re.compile(r"(?:[rRbBuUfF]{1,2}|[@$L])(?=[\"'`])")
JOIN = re.compile(r"[ \t]*(?:\+|\\\n|\.)?[ \t]*(?=[\"'`])")
BARE = re.compile(r"(?:[^\s,;#\"'`(){}\[\]<>|&]|(?<=[^\s])\#|&(?![A-Za-z_][\w.-]*=))+")
REFERENCE = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*\Z")
INNER = re.compile(r"[=:]+")
#: After a colon: a type (dotted, in brackets, optional, or a choice of several), then the equals sign of the same
#: assignment. Without blanks around that sign only a quoted literal tells it from a value that holds one. A colon ends
#: the search, so that each character is read for one sign only.
_IN = r"[^\n=:\[\]<>]*(?:[\[<][^\n=:\[\]<>]*[\]>][^\n=:\[\]<>]*)*"
_ONE = rf"(?:&(?:'[a-z_]+\x20)?(?:mut\x20)?)?[A-Za-z_$][A-Za-z0-9_.$]*(?:\[{_IN}\]|<{_IN}>)?\??"
TYPED = re.compile(rf"[ \t]*{_ONE}(?:[ \t]*\|[ \t]*{_ONE})*(?:[ \t]+=(?=[ \t])|[ \t]*=(?=[ \t]*(?:[rRbBuUfF]{{1,2}}|[@$L])?[\"'`]))", re.ASCII)
#: Names of types that are never names of constants, and words that start a scope.
TYPES = frozenset("str string bytes bytearray int integer long float double number bool boolean char varchar text any object auto final optional none null undefined".split())
SCOPE = re.compile(r"(?:(?:async|export|default|public|private|protected|static|final)[ \t]+)*(?:def|class|function|func|fn)\b")
NAMING, VALUING = frozenset(("key", "name", "id")), frozenset(("value", "val", "default"))
SCOPES = re.compile(r"\b(?:def|class|function|func|fn)\b")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$-")
STARTS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")

Literal = tuple[str, int, int]  # value, start, end


class Constants:
    """Definitions by name in nested scopes."""

    def __init__(self):
        self.scopes: list[tuple[int, dict[str, Literal], dict[str, Literal]]] = [(-1, {}, {})]  # indentation of the opening line

    def enter(self, indent: int) -> None:
        self.scopes.append((indent, {}, {}))

    def line(self, indent: int) -> None:
        """A line starts: scopes that were opened at its indentation or deeper are over."""
        while len(self.scopes) > 1 and indent <= self.scopes[-1][0]:
            self.scopes.pop()

    def define(self, name: str, value: Literal, sure: bool = True) -> None:
        _, known, unsure = self.scopes[-1]
        if sure:
            known[name] = value
            unsure.pop(name, None)
        else:
            unsure[name] = value

    def find(self, name: str, also_unsure: bool) -> Literal | None:
        for _, known, unsure in reversed(self.scopes):
            if name in known:
                return known[name]
            if also_unsure and name in unsure:
                return unsure[name]
        return None


class Lexer:
    """The pairs of one text."""

    def __init__(self, text: str):
        self.text = text
        self.out: list[tuple[str, Literal]] = []
        self.outer = self.constants = Constants()
        self.unclosed: dict[str, int] = {}  # by kind of bracket: up to where it is known not to close
        self.floor = 0  # names start after what was consumed
        self.string: tuple[int, int, int, int] | None = None  # the last string: token start and end, content start and end
        self.key: str | None = None  # the last key="..." whose value is to come
        self.typed_until = -1
        #: A type that stands between colon and equals sign may still be a constant's name ("here: K = ..."): an equals
        #: sign can refer to it, a colon can't, since there it is a type again.

    def closing(self, mark: str, at: int, kind: str) -> int:
        """Where ``mark`` stands at or after ``at``, or -1; a failed search is not tried again."""
        if self.unclosed.get(kind):
            return -1
        found = self.text.find(mark, at)
        if found < 0:
            self.unclosed[kind] = 1
        return found

    def quoted(self, at: int) -> tuple[int, int, int] | None:
        """Content start and end, and token end, of the string that starts at ``at``, prefix included."""
        prefix = PREFIX.match(self.text, at)
        at = prefix.end() if prefix else at
        mark = self.text[at : at + 3]
        if mark in ('"""', "'''"):
            end = self.closing(mark, at + 3, mark)
            return (at + 3, end, end + 3) if end >= 0 else None
        mark = mark[:1]
        if not mark or mark not in "\"'`" or self.text.startswith("```", at):
            return None
        kind, pattern = mark, QUOTED
        if mark == "`" and not self.opens_template(at):
            kind, pattern = "inline", INLINE
        if at < self.unclosed.get(kind, -1):
            return None
        m = pattern.match(self.text, at)
        if not m:
            # No quote closes it in this line, so none closes a later one there.
            end = self.text.find("\n", at) if kind != "`" else -1
            self.unclosed[kind] = end if end >= 0 else len(self.text)
            return None
        return at + 1, m.end() - 1, m.end()

    def opens_template(self, at: int) -> bool:
        while at and self.text[at - 1] in " \t":
            at -= 1
        return at > 0 and self.text[at - 1] in TEMPLATE

    def name(self, sign: int) -> str | None:
        """The name left of a sign."""
        text, at = self.text, sign
        while at > self.floor and text[at - 1] in " \t":
            at -= 1
        while at > self.floor and text[at - 1] in "])":
            at -= 1
        if self.string and self.string[1] == at and self.string[0] >= self.floor - 1:
            found = text[self.string[2] : self.string[3]].strip()
            return found if found and found[0] in STARTS else None
        stop = at
        while at > self.floor and text[at - 1] in NAME_CHARS:
            at -= 1
        while at < stop and text[at] not in STARTS:
            at += 1
        return text[at:stop] or None

    def literal(self, at: int) -> tuple[Literal | None, str | None, bool]:
        """The literal that starts at ``at`` after blanks, or the name that it refers to, and whether it is bare."""
        text = self.text
        while at < len(text) and text[at] in " \t(":
            at += 1
        got = self.quoted(at)
        if not got:
            bare = BARE.match(text, at)
            if not bare:
                return None, None, False
            return (bare[0], bare.start(), bare.end()), bare[0] if REFERENCE.match(bare[0]) else None, True
        value, start, end = "", got[0], got[1]
        while got:
            value, end, after = value + text[got[0] : got[1]], got[1], got[2]
            joint = JOIN.match(text, after)
            got = self.quoted(joint.end()) if joint and joint.end() > after else None
        return (value, start, end), None, False

    def pair(self, name: str, value: Literal) -> None:
        last = name.rpartition(".")[2].lower()
        if last in NAMING and REFERENCE.match(value[0]):
            self.key = value[0]
        elif last in VALUING and self.key:
            name, self.key = self.key, None
        self.out.append((name, value))

    def assigned(self, sign: str, start: int, end: int) -> int:
        """Takes the pair around a sign; returns where to go on."""
        name = self.name(start)
        self.floor = end
        if not name:
            return end
        typed = TYPED.match(self.text, end) if sign == ":" else None
        value, reference, bare = self.literal(typed.end() if typed else end)
        if reference is not None:
            value = self.constants.find(reference, bool(typed) or sign != ":") or value
        if value is None:
            return end
        if end == self.typed_until:
            if name.lower() in TYPES:
                return end
            self.constants.define(name, value, sure=False)
        elif sign != "+=":
            self.constants.define(name, value)
        self.pair(name, value)
        if typed:
            self.typed_until = typed.end()
            return end
        if bare and reference is None:
            self.within(*value[1:])
            self.floor = value[2]
            return value[2]
        return end

    def within(self, start: int, end: int) -> None:
        """The pairs inside a bare value, each literal up to the next sign that a name precedes; trailing signs are literal."""
        signs = [m for m in INNER.finditer(self.text, start, end) if m.end() < end]
        for m, after in zip(signs, [*signs[1:], None], strict=False):
            self.floor = max(self.floor, start)
            name = self.name(m.start()) if len(m[0]) == 1 else None
            self.floor = m.end()
            stop = after.start() if after else end
            if name and m.end() < stop:
                value = (self.text[m.end() : stop], m.end(), stop)
                self.constants.define(name, value)
                self.pair(name, value)

    def pairs(self) -> list[tuple[str, Literal]]:
        text, at = self.text, 0
        comment_end: int | str | None = None
        element: tuple[str, int] | None = None  # the open element and where its content starts
        self.scope_line(0, 0)
        stop = (STOP_LINES if SCOPES.search(text) else STOP).search
        while found := stop(text, at):
            m = TOKEN.match(text, found.start())
            if not m:
                at = found.end()
                continue
            kind, at = m.lastgroup, m.end()
            if comment_end is not None and m.start() >= comment_end:
                self.constants, comment_end = self.outer, None
            if kind == "line":
                self.scope_line(m.start() + 1, at)
            elif kind == "compare":
                self.floor = at
            elif kind == "sign":
                before = text[m.start() - 1 : m.start()] if m[0] == "=" else ""
                if before == "!":
                    self.floor = at
                elif before in ("?", "+"):
                    at = self.assigned(before + "=", m.start() - 1, at)
                else:
                    at = self.assigned(m[0], m.start(), at)
            elif kind in ("quote", "triple"):
                before = text[m.start() - 1] if m.start() else " "
                apostrophe = m[0] == "'" and before.isalnum() and not PREFIX.match(text, m.start() - 1)
                inch = m[0] == '"' and before.isdigit()
                got = None if apostrophe or inch else self.quoted(m.start())
                if got:
                    self.string = (m.start(), got[2], got[0], got[1])
                    at = got[2]
            elif kind == "comment" and comment_end is None:
                closer = CLOSERS.get(m[0], "\n")
                end = self.closing(closer, at, closer)
                self.outer, self.constants = self.constants, Constants()
                comment_end = end if end >= 0 else len(text)
            elif kind == "open":
                element = (m[0][1:], -1)
            elif kind == "angle" and element and element[1] < 0:
                element = (element[0], at)
            elif kind == "close":
                if element and element[0] == m[0][2:] and element[1] >= 0:
                    value = text[element[1] : m.start()]
                    lead = len(value) - len(value.lstrip())
                    if value.strip():
                        self.pair(element[0], (value.strip(), element[1] + lead, element[1] + lead + len(value.strip())))
                element = None
        return self.out

    def scope_line(self, start: int, first: int) -> None:
        self.constants.line(first - start)
        if SCOPE.match(self.text, first):
            self.constants.enter(first - start)


def pairs(text: str) -> list[tuple[str, Literal]]:
    """Names with the literals that they are assigned, references resolved."""
    return Lexer(text).pairs()


def name_score(name: str) -> int:
    words = [w.lower() for w in WORDS.findall(name)]
    alone = max((SENSITIVE.get(w, 0) for w in words), default=0)
    return max([alone, *(COMPANY.get(p, 0) for p in zip(words, words[1:], strict=False))])


def look_score(value: str) -> int:
    if len(value) < 8 or re.search(r"\s", value) or PLACEHOLDER.search(value) or re.match(r"[a-z]+://[^@]*\Z", value):
        return 0
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return 1 + (n >= 12) + (n >= 20) + (bits >= 3) + bool(re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value))


def base_spans(text: str) -> list[Span]:
    out = []
    for kind, pattern, group, least in PATTERNS:
        pattern = LONG_HEX if kind == "hex" else pattern
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans, each by start, then kind as listed (literal last)."""
    base = base_spans(text)
    starts, reach = [s for _, s, _ in base], list(accumulate((e for _, _, e in base), max))
    more = set()
    looks: dict[tuple[int, int], int] = {}
    for name, (value, start, end) in pairs(text):
        if (known := name_score(name)) < 2:
            continue
        held = bisect_right(starts, start)
        if held and reach[held - 1] >= end:
            continue
        if (start, end) not in looks:
            looks[start, end] = look_score(value)
        if known + looks[start, end] >= NEED:
            more.add(("literal", start, end))
    order = [*BASE, "literal"].index
    return base, sorted([*base, *more], key=lambda s: (s[1], order(s[0]), s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans): one row per input row."""
    out = docs.select(F.col(id_col), report(text_col, BASE, spans).alias("found"))
    return out.select(id_col, "found.*")
