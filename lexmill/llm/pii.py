"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, a plus before a digit, digits joined by a dot, neighbouring
digits, "://", and cue words before identifiers, in any case. At each anchor a deterministic parser expands to the boundaries and
validates what it found. Parsers of a kind run left to right and never reach back over what the kind has taken, matched
or dropped, so their results are those of the kind's leftmost non-overlapping matches.

Base kinds, in order: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits). Added kinds:
url (scheme://user:password@host), iban and ssn and account (a number after its cue; ibans pass mod 97).

Defined cases: null and empty texts have no spans; texts are scanned whole; repeated rows each have their row; extra
columns of the input are kept by ``redact`` and not read by ``scan``.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.spans import Span, replaced, report

#: The kinds in order, and the local parsers.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "ssn", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[A-Za-z0-9._~%!$&*+,;=-]+:[^\s/@:]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SCHEME = LETTERS | frozenset("0123456789+.-")
GAP = r"[\s:=#.]*(?i:(?:number|no|nr|num)\b[\s:=#.]*)?"
CUES = {
    "iban": re.compile(GAP + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])"),
    "ssn": re.compile(GAP + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.IGNORECASE),
    "account": re.compile(GAP + r"([0-9](?:-?[0-9]){5,16})(?![0-9A-Za-z-])", re.IGNORECASE),
}
CUE_WORDS = {"iban": ("iban",), "ssn": ("ssn", "social security"), "account": ("account", "acct")}
DIGITS = "0123456789"


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    words = {"@": "email", "://": "url"}
    words |= {f"+{d}": "phone" for d in DIGITS}
    words |= {f"{d}.{e}": "ip" for d in DIGITS for e in DIGITS}
    words |= {f"{d}{gap}{e}": "card" for d in DIGITS for gap in ("", " ", "-") for e in DIGITS}
    words |= {cue: kind for kind, cues in CUE_WORDS.items() for cue in cues}
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Doubles every second digit from the right; the digit sum must divide by ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def email(text: str, at: int, after: int) -> tuple[int, int, bool] | None:
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end(), True) if m else None


def ip(text: str, at: int, after: int) -> tuple[int, int, bool] | None:
    start = at
    while start > after and text[start - 1] in DIGITS:
        start -= 1
    m = IP.match(text, start)
    return (start, m.end(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))) if m else None


def card(text: str, at: int, after: int) -> tuple[int, int, bool] | None:
    m = CARD.match(text, at)
    digits = m[0].replace(" ", "").replace("-", "")
    return at, m.end(), 13 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int, after: int) -> tuple[int, int, bool] | None:
    m = PHONE.match(text, at)
    return (at, m.end(), 9 <= sum(c in DIGITS for c in m[0]) <= 15) if m else None


def url(text: str, at: int, after: int) -> tuple[int, int, bool] | None:
    login = LOGIN.match(text, at + 3)
    if not login:
        return None
    start = first = at
    while start > after and text[start - 1] in SCHEME:
        start -= 1
        if text[start] in LETTERS:
            first = start
    return (first, login.end(), True) if first < at else None


def identifier(kind: str, text: str, end: int) -> tuple[int, int, bool] | None:
    m = CUES[kind].match(text, end)
    if not m:
        return None
    if kind != "iban":
        return m.start(1), m.end(1), True
    # The longest whole group of characters that validates: words may follow an iban.
    value, stop = m[1], m.end(1)
    while len(value) >= 15:
        if mod97(value.replace(" ", "")):
            return m.start(1), stop, True
        value = value[:-1].rstrip()
        stop = m.start(1) + len(value)
    return None


PARSERS = {"email": email, "ip": ip, "card": card, "phone": phone, "url": url}


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans, each by kind as listed, then start."""
    found: dict[str, list[Span]] = {k: [] for k in BASE + ADDED}
    after = dict.fromkeys(found, 0)
    # bytes.lower() changes A-Z only, so places in the text stay the same.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for last, (kind, length) in anchors().iter(lowered):
        at = last - length + 1
        if at < after[kind]:
            continue
        got = PARSERS[kind](text, at, after[kind]) if kind in PARSERS else identifier(kind, text, last + 1)
        if got:
            start, after[kind], valid = got
            if valid:
                found[kind].append((kind, start, after[kind]))
    base = [s for k in BASE for s in found[k]]
    return base, base + [s for k in ADDED for s in found[k]]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per input row."""
    out = docs.select(F.col(id_col), report(text_col, BASE, spans).alias("found"))
    return out.select(id_col, "found.*")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows with personal data replaced by its kind in brackets; chars_col, where there is one, follows the new text."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([replaced(t, spans(t)[1]) if t else t for t in texts.to_pylist()], pa.string())

    out = docs.withColumn(text_col, clean(text_col))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.coalesce(F.length(text_col).cast(kind), F.col(chars_col)))
    return out.select(*docs.columns)
