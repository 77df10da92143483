"""Sequence kernels that Column expressions can't carry: alignment, forced alignment, beam search, block ratios.

Each is a small function of one row; Spark calls it by Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

GAP = 1.0


def matched(a: Sequence, b: Sequence) -> int:
    """How many elements stand in matching blocks: the longest run in common, the first of equal ones, then likewise left and right of it."""
    held, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        lo, hi, left, right = open_.pop()
        size = at = to = 0
        above = [0] * (right - left + 1)
        for i in range(lo, hi):
            row, x = [0] * (right - left + 1), a[i]
            for j in range(left, right):
                if x == b[j]:
                    row[j - left + 1] = run = above[j - left] + 1
                    if run > size:
                        size, at, to = run, i - run + 1, j - run + 1
            above = row
        if size:
            held += size
            open_ += [(lo, at, left, to), (at + size, hi, to + size, right)]
    return held


def _similar(a: str, b: str) -> float:
    return 1.0 if a == b else 2.0 * matched(a, b) / (len(a) + len(b))


def lenient(a: str, b: str) -> float:
    """Edits in which a vowel replaces another at a quarter."""
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        soft, left, new = x in "aeiouy", i + 1.0, [i + 1.0]
        for j, y in enumerate(b):
            left = min(left + 1, row[j + 1] + 1, row[j] + (0.0 if x == y else 0.25 if soft and y in "aeiouy" else 1.0))
            new.append(left)
        row = new
    return row[-1]


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence of two texts; a bit for each letter of a, so that a letter of b takes one step."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    free = every = (1 << len(a)) - 1
    for y in b:
        met = free & at.get(y, 0)
        free = ((free + met) | (free - met)) & every
    return len(a) - free.bit_count()


def align(expected: list[str], actual: list[str]) -> list[tuple[str | None, str | None, str]]:
    """Cheapest alignment of words: a pair costs one less its similarity, a lone word one. Ties prefer pairs, then deletions."""
    n, m = len(expected), len(actual)
    cost = np.zeros((n + 1, m + 1))
    cost[:, 0], cost[0, :] = np.arange(n + 1) * GAP, np.arange(m + 1) * GAP
    pair = np.array([[1 - _similar(x, y) for y in actual] for x in expected]).reshape(n, m)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + pair[i - 1, j - 1], cost[i - 1, j] + GAP, cost[i, j - 1] + GAP)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + pair[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((expected[i], actual[j], "match" if expected[i] == actual[j] else "substitution"))
        elif i and cost[i, j] == cost[i - 1, j] + GAP:
            i -= 1
            out.append((expected[i], None, "deletion"))
        else:
            j -= 1
            out.append((None, actual[j], "insertion"))
    return out[::-1]


def _structs(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    kind = pa.list_(pa.struct(fields))
    return pa.array([None if r is None else [dict(zip([f[0] for f in fields], x, strict=True)) for x in r] for r in rows], kind)


STEP = K.StructType([K.StructField(n, K.StringType()) for n in ("expected", "actual", "status")])
PART = K.StructType([*[K.StructField(n, K.IntegerType()) for n in ("label", "start", "stop")], K.StructField("score", K.DoubleType())])


@F.arrow_udf(K.ArrayType(STEP))
def alignment(expected: pa.Array, actual: pa.Array) -> pa.Array:
    rows = [align(a or [], b or []) for a, b in zip(expected.to_pylist(), actual.to_pylist(), strict=True)]
    return _structs(rows, [("expected", pa.string()), ("actual", pa.string()), ("status", pa.string())])


@F.arrow_udf(K.DoubleType())
def block_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Twice the matching blocks over both lengths, of two texts."""
    return pa.array([_similar(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(K.DoubleType())
def lenient_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([lenient(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(K.IntegerType())
def common_letters(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([longest_common(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


@F.arrow_udf(K.IntegerType())
def block_matches(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many elements the matching blocks of two arrays hold."""
    return pa.array([matched(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


Path = list[list[int]] | None


def forced_many(log_probs: list[np.ndarray], labels: list[list[int]], blanks: list[int]) -> list[Path]:
    """For each row the frames of each label on its best path through blanks and labels in order; None where there is no path.

    Rows of about the same length are padded and go through the frames together. Ties stay, then go to the next state,
    then skip a blank; of two ends the last blank stays.
    """
    out: list[Path] = [None] * len(labels)
    for i in (i for i, x in enumerate(labels) if not x):
        out[i] = []
    todo = sorted((i for i, (p, x) in enumerate(zip(log_probs, labels, strict=True)) if x and len(p)), key=lambda i: (len(log_probs[i]), len(labels[i])))
    for at in range(0, len(todo), 256):
        rows = todo[at : at + 256]
        frames, wide = max(len(log_probs[i]) for i in rows), max(2 * len(labels[i]) + 1 for i in rows)
        scores = np.full((len(rows), frames, wide), -np.inf)
        skips = np.zeros((len(rows), wide), bool)
        for r, i in enumerate(rows):
            states = [blanks[i]]
            for x in labels[i]:
                states += [x, blanks[i]]
            scores[r, : len(log_probs[i]), : len(states)] = log_probs[i][:, states]
            skips[r, 2 : len(states)] = [x != blanks[i] and x != y for x, y in zip(states[2:], states, strict=False)]
        best = np.full((len(rows), wide), -np.inf)
        best[:, :2] = scores[:, 0, :2]
        came, length = np.zeros((len(rows), frames, wide), np.int8), np.array([len(log_probs[i]) for i in rows])
        ends = best.copy()
        for t in range(1, frames):
            one, two = np.full_like(best, -np.inf), np.full_like(best, -np.inf)
            one[:, 1:] = best[:, :-1]
            two[:, 2:] = np.where(skips[:, 2:], best[:, :-2], -np.inf)
            options = np.stack([best, one, two])
            came[:, t] = options.argmax(axis=0)
            best = options.max(axis=0) + scores[:, t]
            ends[length > t] = best[length > t]
        for r, i in enumerate(rows):
            last = 2 * len(labels[i])
            s = last if ends[r, last] >= ends[r, last - 1] else last - 1
            if ends[r, s] == -np.inf:
                continue
            held: list[list[int]] = [[] for _ in labels[i]]
            for t in range(length[r] - 1, -1, -1):
                if s % 2:
                    held[s // 2].append(t)
                s -= came[r, t, s]
            out[i] = [x[::-1] for x in held] if all(held) else None
    return out


def _probs(values: list | None) -> np.ndarray:
    return np.array(values, float) if values else np.zeros((0, 0))


@F.arrow_udf(K.ArrayType(PART))
def forced_alignment(log_probs: pa.Array, labels: pa.Array, blank: pa.Array) -> pa.Array:
    probs, wanted = [_probs(p) for p in log_probs.to_pylist()], labels.to_pylist()
    paths = forced_many(probs, [x or [] for x in wanted], blank.to_pylist())
    told = lambda p, x, found: None if x is None or not len(p) or found is None else [(y, at[0], at[-1], float(np.mean(p[at, y]))) for y, at in zip(x, found, strict=True)]
    return _structs([told(*z) for z in zip(probs, wanted, paths, strict=True)], [("label", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])


SEGMENT = K.StructType([K.StructField("label", K.IntegerType()), K.StructField("at", K.ArrayType(K.IntegerType()))])


@F.arrow_udf(K.ArrayType(SEGMENT))
def segments(log_probs: pa.Array, labels: pa.Array, blank: pa.Array) -> pa.Array:
    """The frames of each label on the best path; null where there is no path, or no frames or labels."""
    wanted = [x or [] for x in labels.to_pylist()]
    paths = forced_many([_probs(p) for p in log_probs.to_pylist()], wanted, blank.to_pylist())
    rows = [list(zip(x, found, strict=True)) if found else None for x, found in zip(wanted, paths, strict=True)]
    return _structs(rows, [("label", pa.int32()), ("at", pa.list_(pa.int32()))])


def beam(log_probs: np.ndarray, blank: int, width: int, bonus: float = 0.0) -> list[int]:
    """The likeliest labelling, summed over its paths, of those that a beam of prefixes keeps; bonus for each label."""
    add = lambda a, b: np.logaddexp(a, b) if max(a, b) > -math.inf else -math.inf
    prefixes = {(): (0.0, -math.inf)}  # ends in blank, ends in its last label
    for frame in log_probs:
        grown: dict[tuple, tuple[float, float]] = {}

        def put(prefix: tuple, in_blank: float, in_label: float, grown: dict = grown) -> None:
            a, b = grown.get(prefix, (-math.inf, -math.inf))
            grown[prefix] = add(a, in_blank), add(b, in_label)

        for prefix, (a, b) in prefixes.items():
            whole = add(a, b)
            put(prefix, whole + frame[blank], b + frame[prefix[-1]] if prefix else -math.inf)
            for k, p in enumerate(frame):
                if k != blank:
                    put((*prefix, k), -math.inf, (a if prefix and prefix[-1] == k else whole) + p + bonus)
        prefixes = dict(sorted(grown.items(), key=lambda x: (-add(*x[1]), x[0]))[:width])
    return list(min(prefixes.items(), key=lambda x: (-add(*x[1]), x[0]))[0])


@F.arrow_udf(K.ArrayType(K.IntegerType()))
def beam_search(log_probs: pa.Array, blank: pa.Array, width: pa.Array) -> pa.Array:
    rows = [beam(np.array(p, float), b, w) if p else [] for p, b, w in zip(log_probs.to_pylist(), blank.to_pylist(), width.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.int32()))


STEPS = K.ArrayType(K.StructType([K.StructField(n, K.IntegerType()) for n in "ijkl"]))


def cheapest(n: int, m: int, steps: list[dict]) -> list[tuple[int, int, int, int]]:
    """The cheapest way from (0, 0) to (n, m) in steps (i, j, k, l): from place (i, j) over k expected and l heard words.

    Steps of up to two by two words cost WRONG unless they are listed at a price; others only where they are listed. A
    word alone costs 1 on the expected side, 0.95 on the other. Of equal ways the one from the smallest place stays.
    """
    price = {(s["i"], s["j"], s["k"], s["l"]): s["price"] for s in steps}
    moves = [(3, 1, None), (2, 2, WRONG), (2, 1, WRONG), (1, 3, None), (1, 2, WRONG), (1, 1, WRONG), (1, 0, 1.0), (0, 1, 0.95)]
    best = [[(math.inf, 0, 0)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, 0, 0)
    for i in range(n + 1):
        for j in range(m + 1):
            for k, w, usual in moves:
                if k <= i and w <= j and (cost := price.get((i - k, j - w, k, w), usual)) is not None and best[i - k][j - w][0] + cost < best[i][j][0]:
                    best[i][j] = (best[i - k][j - w][0] + cost, k, w)
    out, i, j = [], n, m
    while i or j:
        _, k, w = best[i][j]
        i, j = i - k, j - w
        out.append((i, j, k, w))
    return out[::-1]


WRONG = 1.05


@F.arrow_udf(STEPS)
def chunk_path(n: pa.Array, m: pa.Array, steps: pa.Array) -> pa.Array:
    rows = [cheapest(a, b, s or []) for a, b, s in zip(n.to_pylist(), m.to_pylist(), steps.to_pylist(), strict=True)]
    return _structs(rows, [(c, pa.int32()) for c in "ijkl"])


def over(rows: DataFrame, key: str, kernel, *columns: str) -> DataFrame:
    """(key, parts): a kernel over columns of its own node, for columns made by lambdas, which Spark can't hand to a function directly."""
    func = kernel.func

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), func(*b.columns[1:])], [key, "parts"])

    schema = K.StructType([rows.schema[key], K.StructField("parts", kernel.returnType)])
    return rows.select(key, *columns).mapInArrow(run, schema)


def beside(rows: DataFrame, kernel, name: str, *columns: str) -> DataFrame:
    """Rows with a kernel's result in place of the columns it reads; the others are carried along, so no key and no join is needed."""
    func, kept = kernel.func, [c for c in rows.columns if c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(kept)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], func(*b.columns[n:])], [*kept, name])

    schema = K.StructType([*[rows.schema[c] for c in kept], K.StructField(name, kernel.returnType)])
    return rows.select(*kept, *columns).mapInArrow(run, schema)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all tasks: Spark merges partitions that are small in bytes, and reads small files in few tasks, but what follows costs far more than their bytes tell."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, *by)
