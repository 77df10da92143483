"""Token counts by the whole-token shortcut, and token ids, for a byte-level BPE vocabulary file.

A text falls into pieces, each a run of white space with the run of other characters after it. The tokenizer's own
pre-tokens never cross from other characters to white space, so pieces encode independently. Each piece is cut into
pre-tokens. Offline, once per process, every vocabulary string that is a single pre-token is encoded by the library:
those that come back as one token are proven whole. A pre-token among them counts one without any merging; only the
rest is merged. Merging takes the file's own ranks; the same start-up proof checks that it makes each whole string one
token too, so that no pair that is merged out of turn can arise. Pieces are remembered, up to a bound, after which the
memory starts afresh.

Defined cases: null and empty texts have 0 tokens; a text that holds one of the vocabulary's added tokens goes to the
library whole, which treats these strings as its default does; texts are never cut short.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: The pre-token pattern of byte-level BPE, and the characters that Unicode calls white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MEMORY = 400_000


class Pieces(dict):
    """Piece to what ``made`` gives for it; starts afresh when it holds MEMORY pieces."""

    def __init__(self, made: Callable[[str], object]):
        super().__init__()
        self.made = made

    def __missing__(self, piece: str):
        if len(self) >= MEMORY:
            self.clear()
        value = self.made(piece)
        if len(piece) <= 64:
            self[piece] = value
        return value


class Counter:
    """Counts tokens, and gives ids, as the library does for the vocabulary at ``path``."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec["pre_tokenizer"] or {}
        assert (step.get("type"), step.get("add_prefix_space"), spec["normalizer"]) == ("ByteLevel", False, None), "byte-level BPE without normalizer is expected"
        self.cut = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.pre = regex.compile(PRE_TOKEN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        near = _differing(0, FAR)
        # Patterns of their own: a search for fixed strings, or for one set of characters, is much faster than for either.
        self.differing = re.compile(f"[{near}\\U{KNOWN:08x}-\\U0010ffff]")
        self.unusual = re.compile(f"[{near}\\U{FAR:08x}-\\U0010ffff]")
        self.plain = not self.differing.search("".join(map(chr, range(0x100))))
        self.whole: dict[str, int] = self._proven(spec)
        self.counts, self.ids = Pieces(self._count), Pieces(self._ids)

    def _proven(self, spec: dict) -> dict[str, int]:
        """The vocabulary strings that are one pre-token and that the library encodes, alone, as one token, with its id."""
        letters = {v: k for k, v in _byte_letters().items()}
        added = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.merge = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        strings = []
        for token in spec["model"]["vocab"]:
            try:
                strings.append(bytes(letters[c] for c in token).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        strings = [s for s in strings if len(self.pre(s)) == 1]
        encoded = self.library.encode_batch_fast(strings, add_special_tokens=False)
        whole = {s: e.ids[0] for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1}
        self.exact = all(len(self.merge(s.encode())) == 1 for s in whole)
        return whole

    def _encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _merged(self, pre_token: str) -> list[int]:
        return self.merge(pre_token.encode()) if self.exact else self._encode(pre_token)

    def _count(self, piece: str) -> int:
        return sum(1 if p in self.whole else len(self._merged(p)) for p in self.pre(piece))

    def _ids(self, piece: str) -> bytes:
        out: list[int] = []
        for p in self.pre(piece):
            one = self.whole.get(p)
            if one is None:
                out += self._merged(p)
            else:
                out.append(one)
        return array("I", out).tobytes()

    def _odd(self, text: str) -> bool:
        """Whether the text must go to the library whole."""
        if self.special.search(text):
            return True
        if self.plain:
            try:
                text.encode("latin-1")
                return False
            except UnicodeEncodeError:
                pass
        if not self.unusual.search(text):
            return False
        if self.differing.search(text):
            return True
        far = _differing(FAR, KNOWN)
        return bool(far) and re.search(f"[{far}]", text) is not None

    def count(self, text: str) -> int:
        if self._odd(text):
            return len(self._encode(text))
        return sum(map(self.counts.__getitem__, self.cut(text)))

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit numbers, little-endian."""
        if self._odd(text):
            return array("I", self._encode(text)).tobytes()
        return b"".join(map(self.ids.__getitem__, self.cut(text)))


#: Code points below FAR are compared at start-up, those below KNOWN once one is met; texts with others go to the library.
FAR, KNOWN = 0x3000, 0x20000


@lru_cache(maxsize=4)
def _differing(start: int, stop: int) -> str:
    """The code points that the library and PRE_TOKEN take for different kinds, as ranges of a pattern.

    A letter joins a letter before it, a digit a digit, any other sign a sign, and white space none: three lines of text
    for each code point, cut by the library in one call.
    """
    points = [p for p in range(start, stop) if not 0xD800 <= p < 0xE000 and p not in (10, 13)]
    every = "".join(map(chr, points))
    kinds = {"a": set(regex.findall(r"\p{L}", every)), "1": set(regex.findall(r"\p{N}", every)), "!": set(regex.findall(rf"[^{SPACE}\p{{L}}\p{{N}}]", every))}
    library, differ = ByteLevel(add_prefix_space=False, use_regex=True), set()
    for before, own in kinds.items():
        # Each line has three characters; its first two are one pre-token or two.
        text = "".join(f"{before}{c}\n" for c in every)
        joins = {every[a // 3] for _, (a, b) in library.pre_tokenize_str(text) if a % 3 == 0 and b - a == 2}
        differ |= joins ^ own
    out, found = [], sorted(map(ord, differ))
    for p in found:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_count(text: str, name: str = "byte_bpe_50k.json") -> Column:
    """The token count of a text column, as an Arrow function; 0 for null."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        c = counter(vocabulary(name))
        return pa.array([c.count(x) if x else 0 for x in texts.to_pylist()], pa.int64())

    return count(text)


def token_counts(docs: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit): one row per input row."""
    out = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), token_count(text_col, name).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def encoded(docs: DataFrame, id_col: str, text_col: str, name: str, runs: Callable[[], Callable[[object, bytes], Iterator[tuple]]], schema: str) -> DataFrame:
    """Rows that ``runs()``, made anew by each task, makes of (id, ids) of each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, run = counter(vocabulary(name)), runs()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                rows += run(key.as_py(), c.encode(text.as_py() or ""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(f"id {kind.simpleString()}, {schema}")
    names, kinds = fields.names, [to_arrow_type(f.dataType) for f in fields]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(each, fields)
