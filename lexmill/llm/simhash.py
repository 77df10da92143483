"""SimHash near-duplicates by covering locality-sensitive hashing.

A covering family for radius r gives every bit position one of the 2**(r+1)-1 nonzero vectors of GF(2)**(r+1) and has a
mask for every nonzero vector v: the positions whose vector has odd inner product with v. Up to r differing positions
span less than the whole space, so some v is orthogonal to all of them: in that table the pair agrees on the whole mask.
Every pair within the radius therefore meets in some bucket, without exception.

Defined cases: null and empty texts have no word and fingerprint zero, linked like any other; texts of one or two words
have one shingle; equal fingerprints form one class before any comparison, so copies are never expanded into pairs;
repeated rows each keep their row; a component whose ids are all null has a null component_id; extra columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Scratch, components

#: Buckets up to this size are compared pair by pair inside one task; larger ones are linked through one-bit variants.
BUCKET = 1024
SEED = 42
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of lower-cased word shingles, repeats counted; 0 without words."""
    words = text.lower().split()  # bytes: lower() changes A-Z only, split() cuts at \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(n, at + BLOCK)].tolist(), last[at : at + BLOCK].tolist(), strict=False)
        h = np.array([digest(line[i:j], SEED) for i, j in pairs], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = np.array([fingerprint(x.as_buffer().to_pybytes(), width) if x.is_valid else 0 for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fp long")


def masks(radius: int) -> list[int]:
    """The covering masks for pairs of 64-bit fingerprints that differ in at most ``radius`` bits."""
    span = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((i % span + 1) & v).bit_count() % 2) for v in range(1, span + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _local_roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the index of the smallest one it is connected to within the bucket."""
    n = len(fps)
    if n == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= radius
        return np.array([0, 0 if near else 1])
    links = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    root = np.arange(n)
    while True:
        step = np.where(links, root[None, :], n).min(axis=1)
        step = np.minimum(step, step[step])
        if (step == root).all():
            return root
        root = step


def links(reps: DataFrame, radius: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of "at most radius bits"."""
    scratch = scratch or Scratch()
    table_masks = masks(radius)
    rows = reps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(table_masks)
    ])).alias("x")).select("x.t", "x.key", "fp")
    sizes = scratch.cut(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    # Rows of single-member buckets, the bulk, end here. Each member meets its bucket's size by a join, not a window.
    shared = scratch.cut(rows.join(sizes, ["t", "key"]), "simhash-shared")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for bucket in batch.column(0):
                fps = np.sort(bucket.values.to_numpy(zero_copy_only=False))
                root = _local_roots(fps.view(np.uint64), radius)
                away = root != np.arange(len(fps))
                a.append(fps[away])
                b.append(fps[root[away]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    small = shared.where(F.col("n") <= BUCKET).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    found = small.select("fps").mapInArrow(within, "a long, b long")

    # A crowded bucket, exactly: two members within two bits share a variant with at most one bit outside the mask
    # changed, and any two members that share one are within two bits. So a star per variant links what pairs would.
    assert radius == 2, "the variants of crowded buckets are those of radius 2"
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in table_masks])
    crowded = shared.where(F.col("n") > BUCKET).select("t", "fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
    crowded = crowded.select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    stars = scratch.cut(crowded.groupBy("t", "variant").agg(F.min("fp").alias("b"), F.count("*").alias("k")).where("k > 1").drop("k"), "simhash-stars")
    star = crowded.join(stars, ["t", "variant"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return found.unionByName(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: (id_col, fingerprint hex, component_id: the smallest id reachable by links)."""
    scratch = Scratch()
    prints = scratch.cut(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    reps = scratch.cut(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    roots = scratch.cut(components(links(reps, radius, scratch)).select(F.col("node").alias("fp"), "root"), "simhash-roots")
    moved = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()).join(reps, "fp")
    least = scratch.cut(moved.groupBy("root").agg(F.min("rep").alias("least")), "simhash-least")
    named = roots.unionByName(least.select(F.col("root").alias("fp"), "root")).join(least, "root").select("fp", "least")
    classes = scratch.cut(reps.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "simhash-classes")
    out = prints.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
    return scratch.last(out, "simhash-out")
