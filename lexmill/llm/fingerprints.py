"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``k`` smallest distinct hashes of a text's shingles of five words, in order, as an array of longs. Words
are `[^\\x20\\x09-\\x0D]+` with A to Z in lower case; a text of fewer words is one shingle, one without words has none.
Hashes have 63 bits, so that their order as longs is that of the numbers. Sketches merge: the k smallest of a union come
from the k smallest of its parts, so that a text, a source or a table can be sketched in pieces. The estimates are exact
as long as the union has at most k shingles.

Words are hashed with running sums over the bytes of many texts at once: a sum of random numbers by byte, times powers
of an odd number, from which a word's own sum is a difference, shifted to its start by the inverse power.

Defined cases: null and empty texts have an empty sketch; two empty sketches are alike (1), an empty and another are not
(0); a null sketch reads as empty; repeated rows have equal sketches. Columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

K, WIDTH = 128, 5
RUN = 1 << 20
_BYTES = np.random.default_rng(63).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole number."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of the texts in data[bounds[i]:bounds[i + 1]], and where each text's begin."""
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    word = ~space
    opens, closes = word.copy(), word.copy()
    opens[1:] &= space[:-1]
    closes[:-1] &= space[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]  # a text's end ends its last word
    opens[inner] |= word[inner]
    closes[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[lower] * _powers(_BASE, len(data)), out=sums[1:])
    words = _mixed((sums[end] - sums[start]) * _powers(_BACK, len(data))[start] + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)

    first = np.searchsorted(start, bounds)  # each text's words
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(1, count - width + 1), 0)
    at = np.concatenate([[0], np.cumsum(shingles)])
    text = np.repeat(np.arange(len(count)), shingles)
    head = first[text] + np.arange(at[-1]) - at[text]
    out = np.zeros(at[-1], np.uint64)
    for j in range(width):
        inside = head + j < first[text + 1]
        nth = words[np.where(inside, head + j, 0)] if len(words) else out
        out = np.where(inside, _mixed(out * _BASE + nth), out)
    return out >> np.uint64(1), at


def _smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    if len(hashes) > 8 * k:
        # The k smallest distinct ones are among the m smallest, unless repeats leave fewer than k of these.
        few = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def _sketched(texts: pa.Array, k: int, width: int) -> list[np.ndarray]:
    """The sketch of each text, null for none. Texts are read in runs of about RUN bytes, a longer one by itself."""
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    found, a = [], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + RUN, side="right")) - 1)
        hashes, at = shingle_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width)
        found += [_smallest(hashes[at[i] : at[i + 1]], k).astype(np.int64) for i in range(b - a)]
        a = b
    return found


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))


def sketches(text: Column | str, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text column, as an Arrow function."""

    @F.arrow_udf("array<long>")
    def each(texts: pa.Array) -> pa.Array:
        return _lists(_sketched(texts, k, width))

    return each(F.col(text) if isinstance(text, str) else text)


def _held(sketch: Column | str) -> Column:
    return F.coalesce(F.col(sketch) if isinstance(sketch, str) else sketch, F.array().cast("array<long>"))


def merged(a: Column | str, b: Column | str, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(_held(a), _held(b))), 1, k)


def merged_by(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """(keys, sketch): one sketch for each group of rows. Groups without a hash have an empty one.

    Equal hashes of a group fall together before the shuffle, and tasks send on at most the k smallest they have, so a
    group of any size meets in one task with k hashes a task.
    """
    hashes = df.select(*keys, F.explode(_held(sketch)).alias("__hash")).groupBy(*keys, "__hash").agg(F.lit(1).alias("__one"))
    least = hashes.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy("__hash"))).where(F.col("__nth") <= k)
    found = least.groupBy(*keys).agg(F.array_sort(F.collect_list("__hash")).alias(sketch))
    every = df.select(*keys).distinct()
    same = [every[c].eqNullSafe(found[c]) for c in keys]
    return every.join(found, same, "left").select(*[every[c] for c in keys], _held(found[sketch]).alias(sketch))


def resemblance(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimate of the shingles in both texts by those in either, from 0 to 1."""
    a, b = _held(a), _held(b)
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_shingles(sketch: Column | str, k: int = K) -> Column:
    """Estimate of a text's distinct shingles; exact below k."""
    s = _held(sketch)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * F.lit(2.0**63) / F.element_at(s, k))


def containment(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has too, from 0 to 1; 1 if a has none."""
    a, b = _held(a), _held(b)
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def written(sketch: Column | str) -> Column:
    """A sketch as a string of 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(_held(sketch), lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _in_order(docs: DataFrame, made: Callable[[list, list[str]], list[pa.Array]], schema: str, id_col: str, text_col: str) -> DataFrame:
    """(id, what ``made`` gives): each row with the text of the next by descending id; after the last comes the first.

    made: from a run of ids and their texts, and the text behind the last of them, the columns of schema.

    Null ids come last; rows that share an id follow by a hash of their texts, and equal rows in any order; a single row
    is its own next. A null text is an empty one. Ids are integers.

    Keys alone are dealt by range first, to learn which row begins each part. Then texts are shuffled once, to the part
    that holds their key, and each part also gets the text that begins the next one. Parts are as many as shuffle
    partitions, and so are the rows that the driver holds and the texts that go out a second time. A part streams in
    order and holds one row at a time.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # ~id turns the order round; the last column only lets equal rows lie in several parts.
    order = [F.col(id_col).isNull().alias("k0"), F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit(0)).alias("k1"), F.xxhash64(text).alias("k2"), F.monotonically_increasing_id().alias("k3")]
    keys = ["k0", "k1", "k2", "k3"]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *order)
    ranged = rows.select(*keys).repartitionByRange(parts, *keys)
    heads = sorted(tuple(r.head) for r in ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*keys)).alias("head")).toLocalIterator())

    @F.arrow_udf("int")
    def part(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return pa.array([max(0, bisect_right(heads, key) - 1) for key in zip(*(x.to_pylist() for x in (a, b, c, d)), strict=True)], pa.int32())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for key, text, own in zip(*(batch.column(i) for i in range(3)), strict=True):
                now = text.as_py()
                texts.append(now)
                size += len(now)
                if own.as_py() and size < RUN:
                    ids.append(key.as_py())
                    continue
                # The run ends before this row, which is the next of the last one.
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *made(ids, texts)], fields.names)
                ids, texts, size = ([key.as_py()], [now], len(now)) if own.as_py() else ([], [], 0)

    fields = _parse_datatype_string(f"id long, {schema}")
    dealt = rows.withColumn("part", part(*keys)).select("part", F.lit(True).alias("own"), "id", "text", *keys)
    before = spark.createDataFrame([((i - 1) % len(heads), *h) for i, h in enumerate(heads)], "part int, h0 boolean, h1 long, h2 long, h3 long")
    met = rows.join(F.broadcast(before.drop("h3")), (F.col("k0") == F.col("h0")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")))
    # One of equal rows stands for all. After a part's last row comes the guest, whatever its own key.
    guests = met.groupBy("part").agg(F.first("text").alias("text")).select("part", F.lit(False).alias("own"), F.lit(None).cast("long").alias("id"), "text", *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys])
    if not heads:
        return spark.createDataFrame([], fields).withColumnRenamed("id", id_col)
    laid = dealt.unionByName(guests).repartitionById(len(heads), "part").sortWithinPartitions("part", F.desc("own"), *keys)
    return laid.select(F.col("id").cast("long"), "text", "own").mapInArrow(each, fields).withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, next_text): each row with the text of the next by descending id; after the last comes the first."""
    made = lambda ids, texts: [pa.array(texts[:-1], pa.string()), pa.array(texts[1:], pa.string())]
    return _in_order(docs, made, "text string, next_text string", id_col, text_col).withColumnRenamed("text", text_col)


def edited(text: str, following: str) -> str:
    """A text whose second half, the smaller one, is replaced by the first as many code points of another, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, k: int = K, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, edited, sketch, edited_sketch, next_sketch): each text beside its edited form and the next document."""

    def made(ids: list, texts: list[str]) -> list[pa.Array]:
        changed = pa.array([edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)], pa.string())
        own = _sketched(pa.array(texts, pa.string()), k, width)
        return [pa.array(texts[:-1], pa.string()), changed, _lists(own[:-1]), _lists(_sketched(changed, k, width)), _lists(own[1:])]

    return _in_order(docs, made, "text string, edited string, sketch array<long>, edited_sketch array<long>, next_sketch array<long>", id_col, text_col)
