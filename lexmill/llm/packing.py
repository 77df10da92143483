"""Packing token sequences by dominance reduction and best fit.

Only documents longer than a sequence are cut. The plan of a whole corpus needs no more than how many pieces there are of
each length, at most as many numbers as a sequence has tokens: it is made of these counts, in bulk, for all pieces at
once. First the reduction of Martello and Toth: for the longest piece left, if one companion, or a pair, provably
dominates every other filling, that bin is fixed, as often as the counts allow, and the instance shrinks. When no
longest piece can be fixed, it is set aside and the next is tried. What remains is packed best fit, longest first. Then
pieces are numbered among those of their length, task by task, and each finds its bin by its number. No piece passes the driver.

Defined cases: null and empty texts are one piece of the end id; repeated rows are packed each on its own; an empty
table gives no rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut
from lexmill.llm.tokens import encoded

#: Tasks whose counts are summed together.
SPAN = 1_000


class Counts:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, bin_: tuple[int, ...], times: int) -> None:
        for length in bin_:
            self.n[length] -= times
            if not self.n[length]:
                del self.n[length]
                del self.lengths[bisect_left(self.lengths, length)]

    def times(self, bin_: tuple[int, ...]) -> int:
        return min(self.n.get(x, 0) // bin_.count(x) for x in set(bin_))

    def longest(self, limit: int, less: tuple[int, ...] = ()) -> int | None:
        """The longest length within the limit of which one piece more than in ``less`` is left."""
        i = bisect_left(self.lengths, limit + 1) - 1
        while i >= 0 and self.n[self.lengths[i]] <= less.count(self.lengths[i]):
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def shortest(self, k: int, less: tuple[int, ...] = ()) -> list[int]:
        """The k shortest pieces left besides ``less``, fewer if there are not so many."""
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(k - len(out), self.n[length] - less.count(length))
            if len(out) >= k:
                break
        return out


def dominating(counts: Counts, longest: int, size: int) -> tuple[int, ...] | None:
    """A bin that holds ``longest`` and dominates every other feasible bin with it, if one of up to three pieces does."""
    room, own = size - longest, (longest,)
    companion = counts.longest(room, own)
    if companion is None:
        return own  # nothing fits beside it
    if companion == room:
        return longest, companion  # it fills the room: any set that fits can be exchanged for it
    two = counts.shortest(2, own)
    if len(two) < 2 or sum(two) > room:
        return longest, companion  # one more at most, and this is the longest that fits
    three = counts.shortest(3, own)
    if len(three) < 3 or sum(three) > room:
        # Two more at most. The single companion dominates if no pair adds up to more; else a pair does if it holds the
        # companion, its partner the longest that still fits beside it, and no pair without it can beat its parts.
        pair = _best_pair(counts, room, own)
        if pair is None or sum(pair) <= companion:
            return longest, companion
        if pair[0] == companion and sum(pair) == room:
            return longest, *pair
    return None


def _best_pair(counts: Counts, room: int, less: tuple[int, ...]) -> tuple[int, int] | None:
    best = None
    for a in reversed(counts.lengths[: bisect_left(counts.lengths, room + 1)]):
        if counts.n[a] <= less.count(a):
            continue
        b = counts.longest(min(a, room - a), (*less, a))
        if b is not None and (best is None or a + b > sum(best)):
            best = a, b
    return best


def plan(lengths: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, times) that hold every piece, from how many there are of each length."""
    counts, bins = Counts(lengths), []
    aside: list[int] = []
    for longest in sorted(counts.n, reverse=True):
        while counts.n.get(longest):
            found = dominating(counts, longest, size)
            times = found and counts.times(found)
            if not found or not times:
                aside.append(longest)
                break
            # While a bin's pieces last, the conditions that made it dominate still hold: fewer pieces are left each time.
            bins.append((found, times))
            counts.take(found, times)
    return bins + best_fit(counts.n, size)


def best_fit(lengths: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, by groups of equal bins: a group shares its pieces, so equal pieces are placed at once."""
    groups: dict[tuple[int, ...], int] = {}
    rooms: dict[int, list[tuple[int, ...]]] = {}
    order: list[int] = []

    def put(bin_: tuple[int, ...], times: int) -> None:
        if bin_ not in groups:
            room = size - sum(bin_)
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append(bin_)
        groups[bin_] = groups.get(bin_, 0) + times

    def take(bin_: tuple[int, ...], times: int) -> None:
        groups[bin_] -= times
        if not groups[bin_]:
            del groups[bin_]
            room = size - sum(bin_)
            rooms[room].remove(bin_)
            if not rooms[room]:
                del rooms[room]
                del order[bisect_left(order, room)]

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            i = bisect_left(order, length)
            if i == len(order):
                each = size // length
                if left >= each:
                    put((length,) * each, left // each)
                if left % each:
                    put((length,) * (left % each), 1)
                break
            bin_ = rooms[order[i]][0]
            fit = min(order[i] // length, left)
            times = min(groups[bin_], left // fit)
            take(bin_, times)
            put(bin_ + (length,) * fit, times)
            left -= fit * times
    return [(bin_, times) for bin_, times in groups.items()]


class Slots:
    """Where the r-th piece of each length goes: sequence number and offset."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]], lengths: dict[int, int]):
        self.base = {}
        total = 0
        for length in sorted(lengths):
            self.base[length] = total
            total += lengths[length]
        filled = dict(self.base)
        rows, first = [], 0
        for bin_, times in bins:
            at = 0
            for length in bin_:
                rows.append((filled[length], first, at))
                filled[length] += times
                at += length
            first += times
        rows.sort()
        self.start, self.sequence, self.offset = (np.array([x[i] for x in rows], np.int64) for i in range(3))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.array([self.base[x] for x in length.tolist()], np.int64) + rank
        i = np.searchsorted(self.start, g, "right") - 1
        return self.sequence[i] + g - self.start[i], self.offset[i]


def pieces(docs: DataFrame, size: int, end_id: int, name: str, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth) of every document's ids and the end id, cut from the end on.

    part, nth: the task that made the piece, and its number among that task's pieces of the same length.
    """
    end = int(end_id).to_bytes(4, "little")

    def runs() -> Callable[[object, bytes], Iterator[tuple]]:
        part, made = TaskContext.get().partitionId(), Counter()

        def cuts(key: object, ids: bytes) -> Iterator[tuple]:
            ids += end
            n = len(ids) // 4
            edges = [0, *range(n % size or size, n + 1, size)]
            for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                yield key, k, i, j - i, zlib.crc32(ids[4 * i : 4 * j]), part, made[j - i]
                made[j - i] += 1

        return cuts

    return encoded(docs, id_col, text_col, name, runs, "piece int, start long, length long, ids_crc32 long, part long, nth long")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``: numbers from 0 without gaps among the pieces of each length.

    Numbers follow the tasks that made the pieces. How many pieces of a length come before a task's own is summed in two
    steps, over spans of SPAN tasks and within them, from one count for each task and length: a length that a third of
    all pieces have is no hot key. Each task's numbers then meet its pieces as one row, by a sort-merge join.
    """
    sizes = rows.groupBy("part", "length").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("part") / SPAN))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    spans = sizes.groupBy("length", "span").agg(F.sum("n").alias("n")).select("length", "span", sum_before(upto("length", "span")).alias("far"))
    near = sizes.withColumn("near", sum_before(upto("length", "span", "part")))
    bases = near.join(spans, ["length", "span"]).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", F.col("far") + F.col("near")))).alias("bases"))
    return rows.join(bases.hint("merge"), "part").withColumn("rank", F.element_at("bases", F.col("length")) + F.col("nth")).drop("bases")


def pack(docs: DataFrame, size: int = 1024, end_id: int = 2, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id_col, piece, start, length, ids_crc32, sequence_id, offset)."""
    # Written once: a piece's number is what the task that wrote it gave it.
    rows = cut(pieces(docs, size, end_id, name, id_col, text_col), "packing-pieces")
    # The counts are at most ``size`` rows, whatever the corpus.
    lengths = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Slots(plan(lengths, size), lengths)
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    columns = ["id", "piece", "start", "length", "ids_crc32"]
    names = [id_col, *columns[1:], "sequence_id", "offset"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered(rows).select(*columns, "rank").mapInArrow(place, schema)
