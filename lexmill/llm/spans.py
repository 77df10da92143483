"""What the scans of texts for spans share: digests, joined lists, replacement."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[str, int, int]  # kind, start, end in code points, end exclusive


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def report(text: str, base_kinds: tuple[str, ...], scan: Callable[[str], tuple[list[Span], list[Span]]]) -> Column:
    """struct of counts n_<kind>, base_sha256 and spans for a text column. scan: base spans and all spans, in order."""
    names = [f"n_{k}" for k in base_kinds] + ["base_sha256", "spans"]
    kinds = [pa.int64()] * len(base_kinds) + [pa.string()] * 2

    @F.arrow_udf(", ".join([f"n_{k} long" for k in base_kinds] + ["base_sha256 string", "spans string"]))
    def each(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            base, every = scan(text or "")
            found = [k for k, _, _ in base]
            rows.append((*map(found.count, base_kinds), digest(base), joined(every)))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return each(text)


def replaced(text: str, spans: list[Span]) -> str:
    """The text with every span's place taken by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
