"""Fill-in-middle transformation by a table-driven automaton over bytes.

One automaton reads UTF-8: its state says how many continuation bytes are due, how much of a sentinel has been met, and
whether the last unit is still open. Each transition carries two counts: units that begin with this byte, and sentinels
that end with it. A first pass over the bytes adds the counts up by lane, a stretch of ``LANE`` bytes; lanes are read
side by side. The state forgets: after ``memory`` bytes it no longer depends on where it began (worked out from the
table), so that each lane starts so many bytes early instead of waiting for the one before. The second pass goes only
over the lanes that hold a cut, found by the sums, and stops each at the byte where its unit begins.

Units are code points, words (a run of other characters with the white space after it) or lines (with their ends). White
space is x20 and x09 to x0D.

Defined cases: null and empty texts stay plain with 0 units; a null id is drawn as an empty string; a text that holds a
sentinel stays plain, so that a text can always be restored from its output and form; rows that repeat an id are cut
alike; texts are read whole, in runs of rows of about ``RUN`` bytes, a longer text in one run of its own. Columns other
than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle
UNITS = ("character", "word", "line")
LANE, RUN = 256, 1 << 22
#: What a table entry holds: the next state in the low bits, then one bit for a unit that begins, one for a sentinel.
UNIT, SENTINEL, STATE = 1 << 14, 1 << 15, (1 << 14) - 1


def _space(byte: int) -> bool:
    return byte == 0x20 or 9 <= byte <= 13


class Automaton:
    """The table for a unit and a set of sentinels. table: uint16 of states x 256, ``memory``: bytes after which a state forgets."""

    def __init__(self, unit: str = "character", sentinels: tuple[str, ...] = SENTINELS):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}")
        words = [s.encode() for s in sentinels]
        if any(a.startswith(b[i:]) for a in words for b in words for i in range(1, len(b))) or any(a != b and a in b for a in words for b in words) or len(set(words)) < len(words) or not all(words):
            raise ValueError("sentinels must differ, and none may begin with another's end or hold another")
        self.unit, self.words = unit, words
        start = (0, b"", False)
        states, rows = {start: 0}, []
        queue = [start]
        for state in queue:
            row = []
            for byte in range(256):
                nxt, begins, ends = self._step(state, byte)
                if nxt not in states:
                    states[nxt] = len(states)
                    queue.append(nxt)
                row.append(states[nxt] | begins * UNIT | ends * SENTINEL)
            rows.append(row)
        self.table = np.array(rows, np.uint16)
        self.memory = self._memory()

    def _step(self, state: tuple[int, bytes, bool], byte: int) -> tuple[tuple[int, bytes, bool], bool, bool]:
        """(continuation bytes due, part of a sentinel met, a unit is open) after a byte, and what it counts."""
        due, met, open_ = state
        met += bytes([byte])
        ends = met in self.words
        while met and (ends or not any(w.startswith(met) for w in self.words)):
            met = b"" if ends else met[1:]
        if due and byte >> 6 == 2:
            return (due - 1, met, open_), False, ends
        due = 1 if 0xC0 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF8 else 0
        if self.unit == "character":
            return (due, met, False), True, ends
        if self.unit == "line":
            return (due, met, byte != 10), not open_, ends
        # A word is open while its own characters run; the white space after it belongs to it, and the next one begins a word.
        return (due, met, not _space(byte)), not open_ and not _space(byte), ends

    def _memory(self) -> int:
        """The steps after which no two states are left apart, whatever bytes were read."""
        now = self.table & STATE
        apart = {(i, j) for i in range(len(now)) for j in range(i)}
        for n in range(256):
            if not apart:
                return n
            a, b = np.array(sorted(apart)).T
            a, b = now[a].ravel(), now[b].ravel()
            apart = set(zip(np.maximum(a, b)[a != b].tolist(), np.minimum(a, b)[a != b].tolist(), strict=True))
        raise ValueError("the automaton does not forget its start")

    def _walk(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(offset, table entries) for each byte of the lanes side by side. Past a lane's end the state stays and nothing counts."""
        table = np.append(self.table, np.arange(len(self.table), dtype=np.uint16)[:, None], axis=1).ravel()
        state = np.zeros(len(start), np.int64)
        for j in range(-self.memory, int((end - start).max(initial=0))):
            at = start + j
            inside = at < end if j >= 0 else ~first
            byte = np.where(inside, data[np.where(inside, at, 0)].astype(np.int64), 256) if len(data) else np.full(len(at), 256)
            entry = table[state * 257 + byte]
            state = (entry & STATE).astype(np.int64)
            if j >= 0:
                yield j, entry

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Units and sentinels of each text; text i lies in data[bounds[i]:bounds[i + 1]]. The last value serves ``cuts``."""
        lane = max(LANE, self.memory)
        size = np.diff(bounds)
        each = np.maximum(1, -(-size // lane))
        text = np.repeat(np.arange(len(size)), each)
        head = np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.int64)
        nth = np.arange(len(text)) - head[text]
        start = bounds[:-1][text] + nth * lane
        end = np.minimum(start + lane, bounds[1:][text])
        units, sentinels = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for _, entry in self._walk(data, start, end, nth == 0):
            units += (entry & UNIT) > 0
            sentinels += (entry & SENTINEL) > 0
        passed = np.concatenate([[0], np.cumsum(units)])
        total = passed[np.append(head[1:], len(text))] - passed[head] if len(size) else np.zeros(0, np.int64)
        met = np.add.reduceat(sentinels, head) if len(size) else np.zeros(0, np.int64)
        return total, met, (start, end, nth == 0, passed, head, total, bounds)

    def cuts(self, data: np.ndarray, scanned: tuple, after: np.ndarray) -> np.ndarray:
        """For each text the place in data behind its first ``after`` units: the second pass, over the lanes that hold it."""
        start, end, first, passed, head, total, bounds = scanned
        place = np.where(after >= total, bounds[1:], bounds[:-1])
        which = np.flatnonzero((after > 0) & (after < total))
        if len(which):
            goal = passed[head[which]] + after[which]
            lane = np.searchsorted(passed, goal, side="right") - 1
            left = goal - passed[lane]
            for j, entry in self._walk(data, start[lane], end[lane], first[lane]):
                begins = (entry & UNIT) > 0
                here = begins & (left == 0)
                place[which[here]] = start[lane][here] + j
                left -= begins
        return np.where(after <= 0, bounds[:-1], place)


@lru_cache(maxsize=8)
def automaton(unit: str, sentinels: tuple[str, ...]) -> Automaton:
    return Automaton(unit, sentinels)


def _runs(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about RUN bytes."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + RUN, side="right")) - 1)
        yield a, b
        a = b


def draws(key: object, seed: int) -> tuple[int, ...]:
    """Four numbers of 32 bits from an id."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def transform(
    docs: DataFrame, unit: str = "character", plain: int = 10, spm: int = 20, seed: int = 1,
    sentinels: tuple[str, ...] = SENTINELS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, n units, form, prefix_chars, middle_chars, output): one row per input row.

    The two cuts are drawn from all places between units, ends included. ``plain`` per cent of the texts stay as they
    are, and ``spm`` per cent of the others have their suffix first. prefix_chars and middle_chars are null for plain ones.
    """
    Automaton(unit, sentinels)  # a wrong unit or sentinel fails here and not in a task
    P, S, M = (s.encode() for s in sentinels)
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def each(keys: pa.Array, texts: pa.Array) -> pa.Array:
        a = automaton(unit, sentinels)
        texts = texts.fill_null("").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        drawn = [draws(k, seed) for k in keys.to_pylist()]
        rows = []
        for i, j in _runs(bounds):
            own, part = bounds[i : j + 1] - bounds[i], data[bounds[i] : bounds[j]]
            n, met, scanned = a.scan(part, own)
            h = np.array(drawn[i:j], np.int64)
            x, y = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            lo, hi = a.cuts(part, scanned, np.minimum(x, y)), a.cuts(part, scanned, np.maximum(x, y))
            stays = (own[1:] == own[:-1]) | (met > 0) | (h[:, 2] % 100 >= 100 - plain)
            for k in range(j - i):
                text = part[own[k] : own[k + 1]].tobytes()
                if stays[k]:
                    rows.append((int(n[k]), "plain", None, None, text))
                    continue
                p, q = int(lo[k] - own[k]), int(hi[k] - own[k])
                prefix, middle, suffix = text[:p], text[p:q], text[q:]
                first = h[k, 3] % 100 < spm
                out = S + suffix + P + prefix + M + middle if first else P + prefix + S + suffix + M + middle
                rows.append((int(n[k]), "spm" if first else "psm", len(prefix.decode()), len(middle.decode()), out))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(id_col), each(F.col(id_col), F.col(text_col)).alias("__cut")).select(id_col, "__cut.*")


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text again, from a transformed one and its form."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels))
    ordered = F.when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
    return F.when(form == "plain", output).otherwise(ordered)
