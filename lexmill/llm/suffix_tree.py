"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of up to ``depth`` preceding tokens. A context that occurs ``least_context`` times or more is a
candidate; it is retained if its next-token distribution diverges from that of its suffix: the count-weighted
Kullback-Leibler divergence reaches ``divergence`` nats. Contexts are tried level by level, each only where its suffix was
retained, so every state's suffixes are states. A retained state holds the successors that follow it ``least_pair`` times
or more; by Witten and Bell its other mass, what is not held and one for each distinct successor, goes to its suffix's
distribution, and the root's is the add-one unigram distribution. A text is scored at each token by the longest state
that is a suffix of what precedes; texts start after an end token. The bounds are counts, the same for every corpus.

With b the share of a state's mass that goes to its suffix, and p the suffix's probability of a token, a state gives
b * p * (1 + held / (spread * p)). So a token's log10 probability is a sum over the suffixes that are states: log10 b of
each, plus its gain, log10 of the last factor, where the token is held. The model is a table of such summands, of any
size, under the 64-bit hashes of token, context, or context and token; that any two of n entries share a hash has
probability n**2 / 2**65. Tasks hold the HOT most frequent entries, and for the rest a sieve of fixed size that tells
which keys can be in the table; those are asked for in packs, one row for each task and bucket of keys, and answered in
their order. How many are held changes the time, not the sums.

Defined cases: null and empty texts are the end token alone; with no training text every count is zero and N = V = 0;
repeated rows are scored, and counted, each on its own; a null id is held out. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Scratch

END = b""  # words are never empty
#: Distinct tokens that a task holds, pairs that it holds before it sends them on, keys that it asks for at once.
HELD, PAIRS, ASKED = 1 << 19, 1 << 19, 1 << 20
#: Entries that every task holds, and 64-bit words of the sieve for the others.
HOT = 1 << 20
SIEVE = 1 << 20
#: The sieve is made in so many slices.
SLICES = 64
#: A context that occurs more often has its successors summed in parts of about so many occurrences.
LANE = 1 << 20
#: Pairs are summed in buckets of about so many occurrences, but at least in so many buckets.
BUCKET, BUCKETS = 1 << 20, 64
SEED = 42
#: Told apart: a token's entry, and that of a context and token, from that of a context of the same hash.
TOKEN, GAIN = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def words(text: bytes) -> list[bytes]:
    """Words with A-Z lowered; bytes.split() cuts at \\x20 and \\x09-\\x0D."""
    return text.lower().split()


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(True))


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) of a one-column table of binary texts; tokens by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words(text or b""))
            counts[END] += batch.num_rows
            if len(counts) > HELD:
                yield _pairs(counts)
                counts.clear()
        if counts:
            yield _pairs(counts)

    def _pairs(counts: Counter) -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in counts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], ["token", "c"])

    return texts.mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """xxhash64 of two longs, as Spark's function of that name gives it."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    out = np.uint64(SEED)
    with np.errstate(over="ignore"):
        for x in (a, b):
            out = (out + five + np.uint64(8)) ^ (turn(x.view(np.uint64) * two, 31) * one)
            out = turn(out, 27) * one + four
            out = (out ^ (out >> np.uint64(33))) * two
            out = (out ^ (out >> np.uint64(29))) * three
            out = out ^ (out >> np.uint64(32))
    return out.view(np.int64)


def _places(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """np.searchsorted, with the keys in order: a large table is then read in order as well."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(table, keys[order])
    return out


@dataclass
class Known:
    """What a task holds of a table (key, value): its hottest entries, and the sieve that all other keys pass."""

    keys: np.ndarray  # sorted
    values: np.ndarray
    sieve: np.ndarray | None

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values (0 where not held), whether held, and whether the table may hold it beyond."""
        if len(self.keys):
            at = np.minimum(_places(self.keys, keys), len(self.keys) - 1)
            held = self.keys[at] == keys
            values = np.where(held, self.values[at], 0.0)
        else:
            held, values = np.zeros(len(keys), bool), np.zeros(len(keys))
        if self.sieve is None:
            return values, held, np.zeros(len(keys), bool)
        k = keys.view(np.uint64)
        u = lambda x: np.uint64(x)
        bit = lambda word, at: (self.sieve[(word & u(SIEVE - 1)).astype(np.intp)] >> (at & u(63))) & u(1)
        return values, held, ~held & (bit(k, k >> u(26)) & bit(k >> u(32), k >> u(58))).astype(bool)


def hottest(entries: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Keys, in order, and values of the HOT most frequent entries of a table (key, value, weight), and the other entries, if any."""
    step = F.floor(F.log2("weight") * 8)  # at most 512 steps
    steps = sorted(entries.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"])
    room, least = HOT, None
    for r in steps:
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    hot = entries.where(step >= least if least is not None else F.lit(False)).select("key", "value").toArrow()
    keys = hot.column("key").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    keys, values = keys[order], hot.column("value").to_numpy()[order]
    if room >= 0:
        return keys, values, None
    return keys, values, entries.where(step < least) if least is not None else entries


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice of the sieve: the steps between the bits that a task's keys set."""
    u = lambda x: np.uint64(x)
    for (keys,) in _runs(batches, 1):
        k = keys.view(np.uint64)
        bit = lambda word, at: ((word & u(SIEVE - 1)) << u(6)) | (at & u(63))
        bits = np.unique(np.concatenate((bit(k, k >> u(26)), bit(k >> u(32), k >> u(58)))))
        per = u(SIEVE // SLICES * 64)
        steps, edges, start = stepped(bits % per, (bits // per).astype(np.int64))
        yield _rows({"slice": (bits[start] // per).astype(np.int64)}, {"bits": (steps, edges)})


def _slice(table: pa.Table) -> pa.Table:
    out = np.zeros(SIEVE // SLICES * 64, np.uint8)
    for steps in table.column("bits").to_pylist():
        out[np.cumsum(numbers(np.frombuffer(steps, np.uint8)))] = 1
    return pa.table({"slice": table.column("slice").slice(0, 1), "words": pa.array([np.packbits(out, bitorder="little").tobytes()])})


def known(entries: DataFrame) -> tuple[Known, DataFrame | None]:
    """Known of a table (key, value, weight), and the entries that are not held, if any."""
    keys, values, cold = hottest(entries)
    if cold is None:
        return Known(keys, values, None), None
    parts = cold.select("key").mapInArrow(_bits, "slice long, bits binary")
    parts = parts.groupBy("slice").applyInArrow(_slice, "slice long, words binary").toArrow()
    sieve = np.zeros((SLICES, SIEVE // SLICES), np.uint64)
    for at, words in zip(parts.column("slice").to_pylist(), parts.column("words").to_pylist(), strict=True):
        sieve[at] = np.frombuffer(words, np.uint64)
    sieve = sieve.reshape(-1)
    return Known(keys, values, sieve), cold


@dataclass
class Ranks:
    """Frequent tokens numbered by falling frequency, alike in all tasks."""

    keys: np.ndarray  # sorted
    numbers: np.ndarray
    tokens: np.ndarray  # by number

    @classmethod
    def of(cls, keys: np.ndarray, times: np.ndarray) -> Ranks:
        order = np.argsort(-times, kind="stable")
        numbers = np.empty(len(keys), np.int64)
        numbers[order] = np.arange(len(keys))
        return cls(keys, numbers, keys[order])

    def get(self, tokens: np.ndarray) -> np.ndarray:
        """32 bits by which tokens are sorted: their number, or BEYOND and bits of their hash."""
        codes = (tokens & (BEYOND - 1)) | BEYOND
        if len(self.keys):
            at = np.minimum(_places(self.keys, tokens), len(self.keys) - 1)
            codes = np.where(self.keys[at] == tokens, self.numbers[at], codes)
        return codes


class Vocabulary(dict):
    """Tokens to numbers of this task, with their hashes by number, and what ``look`` finds for hashes; starts afresh when it holds HELD."""

    def __init__(self, look: Callable[[np.ndarray], tuple[np.ndarray, ...]]):
        super().__init__()
        self.look = look
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.fresh: list[int] = []
        self.hashes = np.empty(0, np.int64)
        self.found = self.look(self.hashes)

    def __missing__(self, token: bytes) -> int:
        self[token] = number = len(self)
        self.fresh.append(xxhash.xxh64_intdigest(token, SEED))
        return number

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of the texts, each between end tokens, and for each position where its text starts."""
        if len(self) > HELD:
            self.empty()
        end = self[END]
        ids, sizes = [], []
        for t in texts:
            found = words(t or b"")
            ids.append(end)
            ids.extend(map(self.__getitem__, found))
            ids.append(end)
            sizes.append(len(found) + 2)
        if self.fresh:
            fresh = np.array(self.fresh, np.uint64).view(np.int64)
            self.hashes = np.concatenate((self.hashes, fresh))
            self.found = tuple(np.concatenate(x) for x in zip(self.found, self.look(fresh), strict=True))
            self.fresh = []
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        return np.array(ids, np.int64), np.repeat(starts, sizes)


def longer(state: np.ndarray, at: np.ndarray, h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts one longer, of length k, where positions ``at`` have contexts ``state``: positions and contexts."""
    fits = at - k >= first[at]
    at = at[fits]
    return at, h[at - k] if k == 1 else mix(h[at - k], state[fits])


def _chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or b"")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


#: Settings: shuffled files go with the query that wrote them, since all that is read later here are written tables; a
#: task gets so many bytes of texts at once.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Codes of tokens that have no number start here.
BEYOND = 1 << 31
HIGH = np.uint64(0xFFFFFFFF00000000)


def varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 in seven bits a byte, the lowest first: the bytes, and where each number starts and the last ends."""
    numbers = numbers.astype(np.uint64)
    size = np.ones(len(numbers), np.int64)
    most = int(numbers.max(initial=0))
    for k in range(7, 64, 7):
        if most >> k == 0:
            break
        size += numbers >= np.uint64(1 << k)
    edges = np.append(0, np.cumsum(size))
    out = np.empty(edges[-1], np.uint8)
    out[edges[:-1]] = (numbers & np.uint64(127)).astype(np.uint8)
    at = np.arange(len(numbers))
    for k in range(1, 10):
        at = at[size[at] > k]
        if not len(at):
            break
        out[edges[at] + k - 1] |= 128
        out[edges[at] + k] = ((numbers[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
    return out, edges


def numbers(data: np.ndarray) -> np.ndarray:
    """The numbers that ``varints`` wrote."""
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    out = (data[starts] & 127).astype(np.int64)
    at, size = np.arange(len(ends)), ends - starts
    for k in range(1, 10):
        at = at[size[at] >= k]
        if not len(at):
            break
        out[at] |= (data[starts[at] + k] & 127).astype(np.int64) << (7 * k)
    return out


def merged(parts: list[tuple]) -> tuple:
    """Pairs (key, s, next, c) by key, those next to each other summed. Pairs of one key may be told more than once.

    Empties the list; columns are put together one after the other, so little is held twice.
    """
    columns = [list(x) for x in zip(*parts, strict=True)]
    parts.clear()
    order = np.argsort(np.concatenate(columns[0]))
    for k, column in enumerate(columns):
        whole = np.concatenate(column)
        column.clear()
        columns[k] = whole[order]
    key, s, nxt, c = columns
    del columns, order, whole
    new = np.ones(len(s), bool)
    new[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1]) | (nxt[1:] != nxt[:-1])
    at = np.flatnonzero(new)
    return key[at], s[at], nxt[at], np.add.reduceat(c, at) if len(at) else c


def stepped(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising unsigned values as steps, afresh in each group: their bytes, and where the groups start among the bytes (with the end) and among the values."""
    start = np.flatnonzero(np.append(len(groups) > 0, groups[1:] != groups[:-1])) if len(groups) else np.empty(0, np.int64)
    step = np.diff(values, prepend=values[:1])
    step[start] = values[start]
    data, edges = varints(step)
    return data, edges[np.append(start, len(values))], start


def _rows(plain: dict[str, np.ndarray], packed: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of plain columns and of binary ones, which are bytes and their edges."""
    cut = [pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]) for data, edges in packed.values()]
    return pa.RecordBatch.from_arrays([*map(pa.array, plain.values()), *cut], [*plain, *packed])


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Columns of a task's batches, about ASKED rows together."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)])
        size += batch.num_rows
        if size >= ASKED:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of unsigned keys, rising with them."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


PACK = ("states", "sizes", "codes", "counts", "others")


def packs(pairs: tuple, ranks: Ranks, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: contexts, how many successors each has, their numbers as steps upwards, their counts, and the hashes of those without one."""
    key, s, nxt, c = pairs
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | ((key[1:] ^ key[:-1]) & HIGH != 0)
    at = np.flatnonzero(new)
    code = (key & ~HIGH).astype(np.int64)
    beyond = code >= BEYOND
    code = np.where(beyond, len(ranks.tokens), code)
    step = np.diff(code, prepend=0)
    step[at] = code[at]
    (sizes, size_edges), (codes, code_edges), (counts, count_edges) = (varints(x) for x in (np.diff(np.append(at, len(s))), step, c))
    bucket = _bucket(key[at], buckets)
    run = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(at))  # where buckets start among contexts, and among pairs
    pair = np.append(at, len(s))[run]
    streams = {
        "states": (s[at], run * 8), "sizes": (sizes, size_edges[run]), "codes": (codes, code_edges[pair]), "counts": (counts, count_edges[pair]),
        "others": (nxt[beyond], np.append(0, np.cumsum(beyond))[pair] * 8),
    }
    return _rows({"bucket": bucket[run[:-1]]}, streams)


def unpacked(table: pa.Table, ranks: Ranks) -> tuple:
    """Pairs (key, s, next, c) of such rows, unordered."""
    states, sizes, codes, counts, others = (np.frombuffer(b"".join(table.column(n).to_pylist()), np.int64 if n in ("states", "others") else np.uint8) for n in PACK)
    sizes, step, c = numbers(sizes), numbers(codes), numbers(counts)
    at = np.cumsum(sizes) - sizes
    total = np.cumsum(step)
    code = total - np.repeat(total[at] - step[at], sizes)
    s = np.repeat(states, sizes)
    beyond = code == len(ranks.tokens)
    nxt = np.append(ranks.tokens, 0)[code]
    nxt[beyond] = others
    code = np.where(beyond, (nxt & (BEYOND - 1)) | BEYOND, code)
    return (s.view(np.uint64) & HIGH) | code.view(np.uint64), s, nxt, c


def summed(table: pa.Table, ranks: Ranks, least: int) -> pa.Table:
    """(s, next, c, kinds) of a bucket's rows."""
    key, s, nxt, c = unpacked(table, ranks)
    order = np.argsort(key)
    key, s, nxt, c = key[order], s[order], nxt[order], c[order]
    differs = (s[1:] != s[:-1]) | (nxt[1:] != nxt[:-1])
    if (differs & (key[1:] == key[:-1])).any():  # two pairs of one key: those of a pair may not stand together
        order = np.lexsort((nxt, s))
        s, nxt, c = s[order], nxt[order], c[order]
        differs = (s[1:] != s[:-1]) | (nxt[1:] != nxt[:-1])
    at = np.flatnonzero(np.append(True, differs))
    s, nxt, c = s[at], nxt[at], np.add.reduceat(c, at)
    often = c >= least
    rare, less = s[~often], c[~often]
    start = np.flatnonzero(np.append(True, rare[1:] != rare[:-1])) if len(rare) else np.empty(0, np.int64)
    ones, none = np.ones(int(often.sum()), np.int64), np.zeros(len(start), np.int64)
    rows = {
        "s": (s[often], rare[start]), "next": (nxt[often], none), "c": (c[often], np.add.reduceat(less, start) if len(start) else none),
        "kinds": (ones, np.diff(np.append(start, len(rare)))),
    }
    absent = np.append(ones == 0, none == 0)
    return pa.table({n: pa.array(np.concatenate(x), mask=absent if n == "next" else None) for n, x in rows.items()})


def successor_packs(texts: DataFrame, levels: list[Known], ranks: Ranks, buckets: int, shared: Broadcast | None = None) -> DataFrame:
    """(bucket, PACK): how often tokens follow contexts as long as there are levels, as each task has counted them.

    A context's successors go to one bucket, a frequent one's to several. A task sends a row for each bucket, whatever
    contexts it has met: a successor takes one to three bytes by its number, and one without a number eight more. shared:
    levels and ranks, if they are broadcast already.
    """
    shared = shared or texts.sparkSession.sparkContext.broadcast((levels, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, ranks = shared.value
        vocabulary, held, size = Vocabulary(lambda h: (ranks.get(h), *levels[0].get(h))), [], 0
        for batch in batches:
            for chunk in _chunks(batch.column(0).to_pylist()):
                ids, first = vocabulary.read(chunk)
                h = vocabulary.hashes[ids]
                code, *single = vocabulary.found
                at = np.flatnonzero(np.arange(len(ids)) != first)
                state = np.empty(0, np.int64)
                for k, level in enumerate(levels, 1):
                    at, state = longer(state, at, h, first, k)
                    lanes, sure, may = (x[ids[at - 1]] for x in single) if k == 1 else level.get(state)
                    at, state, lanes = at[sure | may], state[sure | may], lanes[sure | may]
                # Lanes follow the table of contexts, so every task deals alike; what only passes the sieve is rare.
                lane = h[at] % np.maximum(lanes, 1).astype(np.int64)
                dealt = np.where(lane > 0, mix(state, lane), state) if lane.any() else state
                key = (dealt.view(np.uint64) & HIGH) | code[ids[at]].view(np.uint64)
                held.append(merged([(key, state, h[at], np.ones(len(at), np.int32))]))
                size += len(held[-1][0])
                if size > 3 * PAIRS // 2:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > PAIRS:
                        yield packs(held.pop(), ranks, buckets)
                        size = 0
        if size:
            yield packs(merged(held), ranks, buckets)

    return texts.mapInArrow(run, f"bucket long, {', '.join(f'{n} binary' for n in PACK)}")


def successor_counts(texts: DataFrame, levels: list[Known], least: int, ranks: Ranks, occurrences: int, shared: Broadcast | None = None) -> DataFrame:
    """(s, next, c, kinds): how often tokens follow contexts as long as there are levels, whose suffixes and selves are in them.

    Successors met ``least`` times or more have a row each, with one kind; a context's others are summed in rows whose next
    is null, with their number as kinds. Of contexts that only pass a sieve, some are not meant: a join with the table of
    contexts leaves them out. occurrences: of all contexts; the more, the more buckets, which one task sums at a time.
    """
    shared = shared or texts.sparkSession.sparkContext.broadcast((levels, ranks))
    found = successor_packs(texts, levels, ranks, max(BUCKETS, occurrences // BUCKET), shared)
    return found.groupBy("bucket").applyInArrow(lambda t: summed(t, shared.value[1], least), "s long, next long, c long, kinds long")


def fit(
    counts: DataFrame, texts: DataFrame, n: int, v: int, depth: int, least_pair: int, least_context: int, divergence: float, last: Scratch
) -> DataFrame:
    """The model: (key, value, weight, token) of tokens, states and held successors.

    A token's value is what its log10 probability has beyond that of a token never met; weight is the entry's count.
    """
    scratch = Scratch()
    never = -math.log10(n + v + 1)
    unigrams = counts.select(F.col("token").alias("next"), F.col("c").alias("times"), F.log10(F.col("c") + 1).alias("lp"))
    unigrams = scratch.cut(unigrams, "suffix-tree-tokens")
    model = unigrams.select(F.col("next").bitwiseXOR(F.lit(TOKEN)).alias("key"), F.col("lp").alias("value"), F.col("times").alias("weight"), F.lit(True).alias("token"))
    # By context: its tokens' hashes, the newest first, and the sum of its suffixes' log10 b.
    contexts = unigrams.where(F.col("times") >= least_context).select(F.col("next").alias("s"), F.array("next").alias("toks"), F.lit(0.0).alias("back"), F.col("times").alias("n"))
    ranks = Ranks.of(*hottest(unigrams.select(F.col("next").alias("key"), F.col("times").alias("value"), F.col("times").alias("weight")))[:2])
    levels: list[Known] = []
    gains: list[DataFrame] = []
    for k in range(1, depth + 1):
        contexts = scratch.cut(contexts, "suffix-tree-contexts")
        if not (occurrences := contexts.agg(F.sum("n")).first()[0]):
            break
        levels.append(known(contexts.select(F.col("s").alias("key"), F.ceil(F.col("n") / LANE).cast("double").alias("value"), F.col("n").alias("weight")))[0])
        shared = texts.sparkSession.sparkContext.broadcast((levels, ranks))
        pairs = scratch.cut(successor_counts(texts, levels, min(least_pair, least_context), ranks, occurrences, shared), "suffix-tree-pairs")
        shared.destroy()  # its copies lie on the disks of the driver and each executor
        held = F.col("next").isNotNull() & (F.col("c") >= least_pair)
        sums = pairs.groupBy("s").agg(F.sum("c").alias("n"), F.sum("kinds").alias("kinds"), F.coalesce(F.sum(F.when(held, F.col("c"))), F.lit(0)).alias("held"))
        sums = sums.withColumn("spread", F.col("n") - F.col("held") + F.col("kinds")).withColumn("b", F.log10(F.col("spread") / (F.col("n") + F.col("kinds"))))
        sums = scratch.cut(contexts.drop("n").join(sums, "s"), "suffix-tree-sums")
        # The held successors, with their probability by the suffix.
        rows = pairs.where(held).join(sums.select("s", "toks", "back", "spread"), "s").join(unigrams.where(F.col("times") >= least_pair).select("next", "lp"), "next")
        rows = rows.withColumn("lp", F.col("lp") + F.col("back") + never)
        for j, gain in enumerate(gains, 1):
            below = gain.select(F.col("key").alias(f"key{j}"), F.col("value").alias(f"gain{j}"))
            rows = rows.withColumn(f"key{j}", _gain_key(_state(F.col("toks"), j), F.col("next"))).join(below, f"key{j}", "left")
            rows = rows.withColumn("lp", F.col("lp") + F.coalesce(f"gain{j}", F.lit(0.0)))
        gain = F.log10(1 + F.col("c") / (F.col("spread") * F.pow(F.lit(10.0), F.col("lp"))))
        rows = scratch.cut(rows.select("s", "next", "c", gain.alias("gain")), "suffix-tree-gains")
        per = rows.groupBy("s").agg(F.sum(F.col("c") * F.col("gain")).alias("gained"))
        far = (F.col("n") * F.col("b") + F.coalesce("gained", F.lit(0.0))) * math.log(10)
        states = scratch.cut(sums.join(per, "s", "left").where(far >= divergence).select("s", "toks", "back", "b", "n"), "suffix-tree-states")
        gains.append(scratch.cut(rows.join(states.select("s"), "s", "left_semi").select(_gain_key(F.col("s"), F.col("next")).alias("key"), F.col("gain").alias("value"), F.col("c").alias("weight")), "suffix-tree-held"))
        model = model.unionByName(states.select(F.col("s").alias("key"), F.col("b").alias("value"), F.col("n").alias("weight"), F.lit(False).alias("token")))
        model = model.unionByName(gains[-1].withColumn("token", F.lit(False)))
        # Contexts one longer, read backwards: a context and a token that follows it often enough, where what is left
        # without the first token is a state.
        joined = pairs.where(F.col("next").isNotNull() & (F.col("c") >= least_context)).join(sums.select("s", "toks"), "s")
        joined = joined.select("c", F.concat(F.array("next"), "toks").alias("toks"))
        joined = joined.select("c", "toks", _state(F.col("toks"), k).alias("suffix"), _state(F.col("toks"), k + 1).alias("s"))
        below = states.select(F.col("s").alias("suffix"), (F.col("back") + F.col("b")).alias("back"))
        contexts = joined.join(below, "suffix").select("s", "toks", "back", F.col("c").alias("n"))
    model = last.cut(model, "suffix-tree-model")
    scratch.drop()
    return model


def _state(toks: Column, k: int) -> Column:
    """The hash of the context of the k newest tokens."""
    out = toks[0]
    for j in range(1, k):
        out = F.xxhash64(toks[j], out)
    return out


def _gain_key(state: Column, token: Column) -> Column:
    return F.xxhash64(state, token).bitwiseXOR(F.lit(GAIN))


def questions(owner: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a pack asks for: a row (bucket, keys) for each bucket, its distinct keys as steps upwards; and a row (sizes,
    steps, times) that stays: how many keys each owner uses, which, by their place among all, and how often."""
    keys, place = np.unique(keys.view(np.uint64), return_inverse=True)
    bucket = _bucket(keys, buckets)
    data, edges, start = stepped(keys, bucket)
    yield _rows({"bucket": bucket[start]}, {"keys": (data, edges)})
    use = np.sort(owner * len(keys) + place)
    start = np.flatnonzero(np.append(True, use[1:] != use[:-1]))
    times = np.diff(np.append(start, len(use)))
    owner, place = np.divmod(use[start], len(keys))
    steps = stepped(place, owner)[0]
    streams = {"sizes": varints(np.bincount(owner))[0], "steps": steps, "times": varints(times)[0]}
    yield _rows({}, {n: (x, np.array([0, len(x)])) for n, x in streams.items()})


def _coded(c: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Answers: 0 for a key that has no entry, 1 for an entry whose value is told, and beyond that a token's count and one."""
    return np.where(c > 0, c + 1, 1), values[c == 0], np.append(0, np.cumsum(c == 0)) * 8


def entry_packs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, codes, gains) of entries (key, value, c), where c is 0 for what is no token."""
    for keys, values, c in _runs(batches, 3):
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        keys, values, c = keys[order], values[order], c[order]
        data, edges, start = stepped(keys, _bucket(keys, buckets))
        run = np.append(start, len(keys))
        codes, gains, at = _coded(c, values)
        codes, code_edges = varints(codes)
        yield _rows({"bucket": _bucket(keys[start], buckets)}, {"keys": (data, edges), "codes": (codes, code_edges[run]), "gains": (gains, at[run])})


def _unstepped(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(np.frombuffer(data, np.uint8)).view(np.uint64))


def _read(codes: bytes, gains: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and the values of those told."""
    codes = numbers(np.frombuffer(codes, np.uint8))
    values = np.zeros(len(codes))
    values[codes == 1] = np.frombuffer(gains, np.float64)
    return codes, values


def answers(asked: pa.Table, entries: pa.Table) -> pa.Table:
    """(pack, bucket, codes, gains) of a bucket: for each pack, what there is for its keys, in their order."""
    none = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0))]
    read = [(_unstepped(k), *_read(c, g)) for k, c, g in zip(*(entries.column(n).to_pylist() for n in ("keys", "codes", "gains")), strict=True)]
    keys, codes, values = (np.concatenate(x) for x in zip(*none, *read, strict=True))
    order = np.argsort(keys)
    keys, codes, values = keys[order], np.append(codes[order], 0), values[order]
    out = []
    for data in asked.column("keys").to_pylist():
        wanted = _unstepped(data)
        at = np.searchsorted(keys, wanted)
        at[np.append(keys, 0)[at] != wanted] = len(keys)
        code = codes[at]
        out.append((varints(code)[0].tobytes(), values[at[code == 1]].tobytes()))
    return pa.table({"pack": asked.column("pack"), "bucket": asked.column("bucket"), "codes": pa.array([x for x, _ in out], pa.binary()), "gains": pa.array([x for _, x in out], pa.binary())})


def gathered(uses: pa.Table, told: pa.Table) -> pa.Table:
    """(row, known_more, base_more, score_more) of a pack's owners."""
    told = told.sort_by("bucket")
    codes, values = _read(*(b"".join(told.column(n).to_pylist()) for n in ("codes", "gains")))
    c = np.maximum(codes - 1, 0)
    base = np.log10(c + 1.0)
    sizes, steps, times = (numbers(np.frombuffer(uses.column(n)[0].as_py(), np.uint8)) for n in ("sizes", "steps", "times"))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.cumsum(steps)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    place = total - np.repeat(total[first] - steps[first], sizes[sizes > 0])
    each = lambda x: np.bincount(owner, x[place] * times, len(sizes))
    return pa.table({
        "row": uses.column("pack")[0].as_py() + np.arange(len(sizes)), "known_more": each(c > 0).astype(np.int64),
        "base_more": each(base), "score_more": each(base + values),
    })


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 2,
    least_pair: int = 10, least_context: int = 128, divergence: float = 12.0, held: Column | None = None,
) -> DataFrame:
    """One row per input row: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    conf = docs.sparkSession.conf
    before = {k: conf.get(k) for k in SETTINGS}
    for k, x in SETTINGS.items():
        conf.set(k, x)
    try:
        return _score(docs, id_col, text_col, depth, least_pair, least_context, divergence, held)
    finally:
        for k, x in before.items():
            conf.set(k, x)


def _score(docs: DataFrame, id_col: str, text_col: str, depth: int, least_pair: int, least_context: int, divergence: float, held: Column | None) -> DataFrame:
    scratch = Scratch()
    held = held_out(id_col) if held is None else held
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    learned = rows.where(~F.col("held")).select("text")
    counts = scratch.cut(token_counts(learned), "suffix-tree-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    model = fit(counts, learned, n, v, depth, least_pair, least_context, divergence, scratch)
    scratch.drop(counts)
    hot, cold = known(model)
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    never = -math.log10(n + v + 1)
    buckets = max(BUCKETS, n // (BUCKET // 2))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {kind}, held boolean, n_tokens long, n_known long, base double, score double, pack long, bucket long, keys binary, sizes binary, steps binary, times binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        vocabulary = Vocabulary(lambda h: (*table.get(h ^ TOKEN), *table.get(h)))
        begun = row = TaskContext.get().partitionId() << 33
        held, size = [], 0
        for batch in batches:
            done = 0
            for chunk in _chunks(batch.column(2).to_pylist()):
                ids, first = vocabulary.read(chunk)
                h = vocabulary.hashes[ids]
                starts, text = np.unique(first, return_inverse=True)
                scored = np.arange(len(ids)) != first
                value, sure, may = (x[ids] for x in vocabulary.found[:3])
                single = vocabulary.found[3:]
                base = np.where(scored, value + never, 0.0)
                asked = [(text[may & scored], h[may & scored] ^ TOKEN)]
                total = base.copy()
                at, state = np.flatnonzero(scored), np.empty(0, np.int64)
                for k in range(1, depth + 1):
                    at, state = longer(state, at, h, first, k)
                    value, there, maybe = (x[ids[at - 1]] for x in single) if k == 1 else table.get(state)
                    total[at] += value
                    asked.append((text[at[maybe]], state[maybe]))
                    at, state = at[there | maybe], state[there | maybe]
                    key = mix(state, h[at]) ^ GAIN
                    value, _, maybe = table.get(key)
                    total[at] += value
                    asked.append((text[at[maybe]], key[maybe]))
                each = lambda x: pa.array(np.bincount(text, np.where(scored, x, 0), len(starts)))  # noqa: B023, E731
                whole = lambda x: each(x).cast(pa.int64())  # noqa: B023, E731
                columns = [
                    pa.array(np.arange(row, row + len(chunk))), batch.column(0).slice(done, len(chunk)), batch.column(1).slice(done, len(chunk)),
                    whole(1.0), whole(sure), each(base), each(total),
                ]
                yield filled(columns, len(chunk))
                owner, keys = (np.concatenate(x) for x in zip(*asked, strict=True))
                held.append((owner + (row - begun), keys))
                size += len(keys)
                done += len(chunk)
                row += len(chunk)
                if size > ASKED:
                    yield from asking(held, begun, batch.column(0).type)
                    begun, held, size = row, [], 0
        if size:
            yield from asking(held, begun, batch.column(0).type)

    def filled(columns: list[pa.Array], size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), *[pa.nulls(size, pa.binary())] * 4], names)

    def asking(held: list, begun: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for found in questions(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets):
            size = found.num_rows
            has = lambda name: found.column(name) if name in found.schema.names else pa.nulls(size, pa.int64() if name == "bucket" else pa.binary())  # noqa: B023, E731
            empty = [pa.nulls(size, x) for x in (pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(np.full(size, begun)), *map(has, names[8:])], names)

    found = rows.mapInArrow(partial, schema)
    if cold is None:
        more = found.withColumns({"known_more": F.lit(0), "base_more": F.lit(0.0), "score_more": F.lit(0.0)})
    else:
        found = scratch.cut(found, "suffix-tree-scores")
        shared.destroy()
        asked = found.where("bucket is not null").select("pack", "bucket", "keys")
        entries = cold.select("key", "value", F.when(F.col("token"), F.col("weight")).otherwise(0).alias("c")).mapInArrow(lambda x: entry_packs(x, buckets), "bucket long, keys binary, codes binary, gains binary")
        told = asked.groupBy("bucket").cogroup(entries.groupBy("bucket")).applyInArrow(answers, "pack long, bucket long, codes binary, gains binary")
        uses = found.where("sizes is not null").select("pack", "sizes", "steps", "times")
        sums = uses.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(gathered, "row long, known_more long, base_more double, score_more double")
        more = found.where("row is not null").select(*names[:7]).join(sums, "row", "left")
    or_0 = lambda c: F.coalesce(c, F.lit(0))
    out = more.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + or_0("known_more")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.round(F.col("base") + or_0("base_more"), 6).alias("base_score"),
        F.round(F.col("score") + or_0("score_more"), 6).alias("score"),
    )
    out = scratch.last(out, "suffix-tree-out")
    if cold is None:
        shared.destroy()
    return out
