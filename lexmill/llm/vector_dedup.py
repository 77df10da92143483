"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosine verification and connected components.

Vectors link only within a label. Equal vectors of a label form one class first, so a vector that fills a third of the
table costs one row. Every class gets ``tables`` signatures of ``bits`` hyperplane signs each, together its sketch; classes
that share a signature lie in one cell. Cells are searched twice. First only sketches travel: a pair goes on if its
sketches differ in no more signs than a pair at the threshold does with six standard deviations to spare, and only in
the first table that it shares. Then the vectors of classes that still have a partner travel, to those cells alone, and
their cosines are taken in double precision. Cells of more than BLOCK members are dealt by hash to blocks that meet in
pairs, so no task holds a whole cell.

At cosine 0.98 two vectors agree on one sign with probability q = 1 - acos(0.98)/pi = 0.936. ``bits`` follows the number of
classes in the largest label, so that chance cells stay small, and ``tables`` follows ``bits``: as many as bring the
probability that a pair at the threshold shares none, (1 - q**bits)**tables, under ``miss``; closer pairs are missed more
rarely. The six deviations add about 1e-9.

Defined cases: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of different lengths do not link; a repeated vec_id keeps its rows, each a vector of its own; a null
vec_id takes part but names no component. Vectors are told apart by two 64-bit hashes. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Scratch, components

#: Members of a cell that are compared together; larger cells become pairs of blocks.
BLOCK = 512
#: Rows that a comparing task looks at together.
CHUNK = 1 << 16
#: Pairs that are looked at together.
PAIRS = 1 << 18


def shape(classes: int, least: float, miss: float) -> tuple[int, int]:
    """bits and tables for so many classes in the largest label."""
    agree = 1 - math.acos(least) / math.pi
    bits = min(48, max(8, math.ceil(math.log2(max(classes, 1) / 32))))
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def signatures(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(cls, sketch binary: tables signatures of whole bytes) of classes (cls, v)."""
    width = -(-bits // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(1)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            sketch = np.zeros((len(sizes), tables * width), np.uint8)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((dim, bits * tables))
                rows = flat[starts[at][:, None] + np.arange(dim)]
                rows /= np.abs(rows).max(axis=1, keepdims=True)
                side = (rows @ planes[dim] > 0).reshape(len(at), tables, bits)
                sketch[at] = np.packbits(side, axis=2).reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sketch], pa.binary())], ["cls", "sketch"])

    return classes.select("cls", "v").mapInArrow(run, "cls long, sketch binary")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about CHUNK rows of a sorted stream, cut where the first ``keys`` columns change, with each row's run number."""
    held: list[pa.RecordBatch] = []
    size = 0

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for k in range(keys):
            column = table.column(k).combine_chunks()
            new[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        run = numbered(table)
        last = int(np.searchsorted(run, run[-1]))
        if last:
            yield table.slice(0, last), run[:last]
        held = table.slice(last).combine_chunks().to_batches()
        size = len(table) - last
    if size:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def _pairs(run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) of rows of one run, by their distance, some PAIRS at a time."""
    left, right, size = [], [], 0
    at = np.arange(len(run))
    gap = 1
    while len(at):
        at = at[at + gap < len(run)]
        at = at[run[at] == run[at + gap]]
        left.append(at)
        right.append(at + gap)
        size += len(at)
        gap += 1
        if size >= PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def _sketches(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(table), -1)


def _plausible(table: pa.Table, i: np.ndarray, j: np.ndarray, sketch: np.ndarray, bits: int, tables: int, most: float) -> np.ndarray:
    """Which pairs are theirs to compare: of different blocks where two blocks meet, of close sketches, in the first table shared."""
    width = sketch.shape[1] // tables
    ok = np.ones(len(i), bool)
    lo, hi, block, t = (table.column(c).to_numpy() for c in ("lo", "hi", "block", "t"))
    ok &= (lo[i] == hi[i]) | (block[i] != block[j])
    differ = sketch[i] ^ sketch[j]
    ok &= np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most
    at = np.flatnonzero(ok)
    same = ~differ[at].reshape(len(at), tables, width).any(axis=2)
    ok[at] = same.argmax(axis=1) == t[i[at]]
    return ok


def _reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is connected to by the links i - j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        step = root.copy()
        np.minimum.at(step, i, low)
        np.minimum.at(step, j, low)
        step = step[step]
        if (step == root).all():
            return root
        root = step


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = 0.98, miss: float = 4e-5, seed: int = 7,
) -> DataFrame:
    """One row per input row: (id_col, n_links, component_id, kept)."""
    scratch = Scratch()
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col) if single else F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    zero = F.lit(0.0).cast("float") if single else F.lit(0.0)
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + zero)))  # -0.0 becomes 0.0
    key = F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64(F.lit(1), "v", "label").alias("b")))
    keyed = scratch.cut(rows.select("id", key.alias("key"), "label", "v"), "vectors-rows")
    grouped = keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    # Written once, so that the numbers given to classes stay what they are.
    classes = scratch.cut(grouped.select(F.monotonically_increasing_id().alias("cls"), "*"), "vectors-classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = shape(largest, least, miss)
    signs = bits * tables
    part = math.acos(least) / math.pi
    most = signs * part + 6 * math.sqrt(signs * part * (1 - part))

    sigs = signatures(classes, bits, tables, seed).join(classes.select("cls", "label", F.size("v").alias("dim"), "m"), "cls")
    sigs = scratch.cut(sigs, "vectors-sigs")
    width = -(-bits // 8)
    met = sigs.select("cls", "label", "dim", "sketch", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"))
    # A cell's number; should two cells share one, their members fail the tests that follow.
    cell = F.xxhash64("label", "dim", "t", F.expr(f"substring(sketch, t * {width} + 1, {width})"))
    met = met.select(cell.alias("cell"), "t", "cls", "sketch")
    heavy = scratch.cut(met.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "vectors-heavy")
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1))
    placed = met.join(heavy, "cell", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "t", "block", "cls", "sketch")
    meeting = ["cell", "lo", "hi", "t"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, run in _runs(batches, 4):
            size = np.bincount(run)[run]
            table, run = table.filter(pa.array(size > 1)), run[size > 1]
            if not len(run):
                continue
            sketch = _sketches(table, "sketch")
            take = np.zeros(len(run), bool)
            for i, j in _pairs(run):
                ok = _plausible(table, i, j, sketch, bits, tables, most)
                take[i[ok]] = True
                take[j[ok]] = True
            yield from table.filter(pa.array(take)).drop_columns(["sketch"]).combine_chunks().to_batches()

    sorted_ = placed.repartition("cell", "lo", "hi").sortWithinPartitions(*meeting)
    hits = scratch.cut(sorted_.mapInArrow(candidates, "cell long, lo int, hi int, t int, block int, cls long"), "vectors-candidates")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, run in _runs(batches, 4):
            sketch = _sketches(table, "sketch")
            lists = table.column("v").combine_chunks()
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            # Where squares would overflow or vanish, vectors are scaled first; cosines don't change.
            top = np.maximum.reduceat(np.abs(flat), starts)
            scale = np.where((top > 1e100) | (top < 1e-100), top, 1.0)
            flat /= np.repeat(scale, sizes)
            norm = np.sqrt(np.add.reduceat(flat * flat, starts))
            label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            m, cls = table.column("m").to_numpy(), table.column("cls").to_numpy()
            count = np.zeros(len(run), np.int64)
            left, right = [], []
            for i, j in _pairs(run):
                ok = _plausible(table, i, j, sketch, bits, tables, most) & (label[i] == label[j]) & (sizes[i] == sizes[j])
                i, j = i[ok], j[ok]
                for dim in np.unique(sizes[i]):
                    one = sizes[i] == dim
                    a, b = i[one], j[one]
                    dot = np.einsum("ij,ij->i", flat[starts[a][:, None] + np.arange(dim)], flat[starts[b][:, None] + np.arange(dim)])
                    near = dot / (norm[a] * norm[b]) >= least
                    a, b = a[near], b[near]
                    np.add.at(count, a, m[b])
                    np.add.at(count, b, m[a])
                    left.append(a)
                    right.append(b)
            if count.any():
                # Of the links only what connects the same rows goes on: each to the smallest that it reaches here.
                root = _reached(len(run), np.concatenate(left), np.concatenate(right))
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(count[at]), pa.array(cls[root[at]])], ["cls", "n", "link"])

    carried = hits.join(sigs.select("cls", "sketch", "m", "label"), "cls").join(classes.select("cls", "v"), "cls")
    carried = carried.select(*meeting, "block", "cls", "sketch", "m", "label", "v").repartition("cell", "lo", "hi").sortWithinPartitions(*meeting)
    found = scratch.cut(carried.mapInArrow(links, "cls long, n long, link long"), "vectors-links")
    scratch.drop(sigs, heavy, hits)

    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("link").alias("b")))
    named = classes.select("key", "cls", "m", "least").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    named = scratch.cut(named.drop("node"), "vectors-roots")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per = named.join(smallest, "root").join(counts, "cls", "left")
    per = per.select("key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = keyed.select("id", "key").join(per, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
    return scratch.last(out, "vectors-components")
