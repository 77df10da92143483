"""Exact top-k inner products by norm-bucketed retrieval.

Candidates lie in buckets of similar length, longest first, many buckets to a slab; queries lie in blocks. Slabs and blocks
are written tables, and a task of their product reads some of either: no copy of a block is broadcast or shuffled. A task
keeps its blocks' k best over the slabs that it meets. A first round over the slab of the longest vectors gives every query a
running k-th best score; the second round meets the other slabs with it. In a bucket whose longest vector has length l, a
query of length |q| with k-th best score s needs cosine s / (|q| l) or more: above 1 the bucket is passed over. Where
these local thresholds are high the bucket prunes by coordinate (the feasible range of a candidate's coordinate, given
the query's, read from sorted lists), else by length (only candidates of length s / |q| or more). What is left is
verified by its exact integer product.

Candidates lie in at most LANES lanes by length, each lane dealt out to slabs by hash. Once every query has a running k-th
best score, it needs only the lanes whose longest vector can reach that score; queries that need equally many lanes
share blocks, so a block meets no slab that all of its queries pass over.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, as neither query nor
candidate; a null id takes no part; rows that repeat an id are each a query and a candidate of their own, so such a query
has its k rows once for each; vectors of different lengths are compared as if zeros followed the shorter; zero vectors
score 0; ties go to the smaller id; a query with fewer than k candidates returns them all; an empty table gives no rows.
Products are exact: in floats where lengths bound them under 2**24, in doubles under 2**53, in 64-bit integers where they bound them under
2**62, else in integers without bound. Scores beyond a long, which the column can't hold, are held at its ends and tie
there. Extra columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import Scratch

BUCKET = 512
#: Candidates to a slab and queries to a block: what one task holds.
SLAB = 16_384
BLOCK = 1024
#: A bucket whose median local threshold is this or more prunes by coordinate.
STEEP = 0.8
#: Bands of length at most, whatever the number of vectors.
LANES = 64
#: Parts of the slabs at most that a product has: each tells the k best of every query that it meets.
SIDES = 16
LONG = (1 << 63) - 1
NO_FLOOR = -(1 << 63)


def _matrix(side: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids, rows padded with zeros to one width, and floors, of a list of structs (row, id, v and perhaps floor)."""
    cells = side.values
    own = cells.field("row").to_numpy(zero_copy_only=False)
    ids, lists = cells.field("id").to_numpy(zero_copy_only=False), cells.field("v")
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.zeros((len(ids), sizes.max(initial=0)))
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = flat
    names = [f.name for f in cells.type]
    floors = cells.field("floor").fill_null(NO_FLOOR).to_numpy(zero_copy_only=False) if "floor" in names else np.empty(0, np.int64)
    return own, ids, rows, floors


def _norms(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((rows * rows).sum(axis=1))  # infinite where squares overflow: nothing is pruned by it


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number, list of structs) to (number, the list's arrays in bytes), longest first, in the least kind that holds them."""
    for batch in batches:
        packs = []
        for side in batch.column(1):
            own, ids, rows, floors = _matrix(side)
            order = np.lexsort((own, ids, -_norms(rows)))
            most = np.abs(rows).max(initial=0)
            kind = next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64)
            to = io.BytesIO()
            for x in (own[order], ids[order], rows[order].astype(kind), floors[order] if len(floors) else floors):
                np.save(to, x, allow_pickle=False)
            packs.append(to.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packs, pa.binary())], ["number", "pack"])


def _unpacked(pack: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = io.BytesIO(pack.as_py())
    own, ids, rows, floors = (np.load(at, allow_pickle=False) for _ in range(4))
    return own, ids, rows.astype(np.float64), floors


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Bucket:
    """Candidates of similar length, longest first, with sorted lists of unit coordinates made when first asked for."""

    def __init__(self, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, norms: np.ndarray):
        self.own, self.ids, self.rows, self.norms = own, ids, rows, norms
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            unit = self.rows[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(unit)
            self._lists[f] = unit[order], order
        return self._lists[f]

    def by_coordinate(self, q: np.ndarray, theta: float) -> np.ndarray:
        """Candidates that the query's largest coordinate leaves in range: |q_f p_f| + sqrt((1-q_f^2)(1-p_f^2)) bounds the cosine."""
        f = int(np.argmax(np.abs(q)))
        a, b = q[f], np.sqrt(max(0.0, (1 - q[f] ** 2) * (1 - theta**2)))
        values, order = self.coordinate(f)
        low = a * theta - b if a >= -theta else -1.0
        high = a * theta + b if a <= theta else 1.0
        return order[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, "right")]


class Best:
    """The k best ids and scores of each of a block's queries so far, by query."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.need = k, floors.copy()
        self.at, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self._more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(at):
            self._more.append((at, ids, scores))
            if 2 * sum(len(x[0]) for x in self._more) > len(self.at):
                self.settle()

    def settle(self) -> None:
        """Merges what was added, and raises what a score needs to count."""
        if not self._more:
            return
        at, ids, scores = (np.concatenate(x) for x in zip((self.at, self.ids, self.scores), *self._more, strict=True))
        self._more = []
        order = np.lexsort((ids, ~scores, at))  # -scores would overflow at a long's least value
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        order, full = order[rank < self.k], order[rank == self.k - 1]
        self.need[at[rank == self.k - 1]] = np.maximum(self.need[at[rank == self.k - 1]], scores[full])
        self.at, self.ids, self.scores = at[rank < self.k], ids[order], scores[order]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products without rounding, held within a long. Whole doubles of any size are exact as integers."""
    whole = lambda x: np.frompyfunc(int, 1, 1)(x).astype(object)
    return np.clip(whole(a) @ whole(b), -LONG - 1, LONG).astype(np.int64)


def search(queries: tuple, buckets: list[Bucket], best: Best) -> None:
    """Adds to best what these buckets hold. queries: row numbers, rows, norms."""
    own, rows, norms = queries
    need = best.need
    longest = max(norms.max(initial=0), max((b.norms[0] for b in buckets), default=0))
    bound = norms.max(initial=0) * max((b.norms[0] for b in buckets), default=0)
    if bound < 2.0**24 and longest < 2.0**24:
        product = lambda a, b: a.astype(np.float32) @ b.astype(np.float32)
    elif bound < 2.0**53:
        product = lambda a, b: a @ b
    elif bound < 2.0**62:
        product = lambda a, b: a.astype(np.int64) @ b.astype(np.int64)
    else:
        product = _exact
    for bucket in buckets:
        with np.errstate(divide="ignore", invalid="ignore"):
            theta = need / (norms * bucket.norms[0])
        theta = np.where(np.isnan(theta), -1.0, theta)  # zero against zero: nothing to prune by
        live = np.flatnonzero(theta <= 1 + 1e-12)
        if not len(live):
            continue
        if np.median(theta[live]) >= STEEP:
            picks = [(i, bucket.by_coordinate(rows[i] / norms[i], min(1.0, theta[i])) if theta[i] > 0 and norms[i] > 0 else np.arange(len(bucket.ids))) for i in live]
            asks, at = np.repeat(live, [len(at) for _, at in picks]), np.concatenate([at for _, at in picks])
            scores = np.concatenate([product(bucket.rows[at], rows[i]) for i, at in picks])
            take = scores >= need[asks]
            asks, at, scores = asks[take], at[take], scores[take]
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where((need[live] > 0) & (norms[live] > 0), need[live] / norms[live], 0.0)
            reach = np.searchsorted(-bucket.norms, -shortest.min() * (1 - 1e-12), "right")
            products = product(bucket.rows[:reach], rows[live].T)
            at, asks = np.divmod(np.flatnonzero(products >= need[live].astype(products.dtype)), len(live))
            scores, asks = products[at, asks], live[asks]
        take = bucket.own[at] != own[asks]
        best.add(asks[take], bucket.ids[at[take]], scores[take].astype(np.int64))
    best.settle()


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (block's number, query block, slab's number, slab), those of a slab together, to each query's best of all slabs here."""
    met: dict[int, tuple] = {}
    made, side, buckets = None, (), []
    for batch in batches:
        for number, block, slab, pack in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
            asking, qids, q, floors = _unpacked(block)
            if made is None or made[0] != slab:
                made, side = None, _unpacked(pack)
            own, ids, c, _ = side
            width = max(q.shape[1], c.shape[1])
            if made != (slab, width):
                c = _widen(c, width)
                norms, made = _norms(c), (slab, width)
                buckets = [Bucket(own[i : i + BUCKET], ids[i : i + BUCKET], c[i : i + BUCKET], norms[i : i + BUCKET]) for i in range(0, len(own), BUCKET)]
            if number not in met:
                met[number] = asking, qids, Best(floors, k)
            search((asking, _widen(q, width), _norms(q)), buckets, met[number][2])
    for asking, qids, best in met.values():
        if len(best.at):
            yield pa.RecordBatch.from_arrays([pa.array(asking[best.at]), pa.array(qids[best.at]), pa.array(best.ids), pa.array(best.scores)], ["query", "query_id", "id", "score"])


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(row, id, v: floor(scale * x) as doubles) of the vectors that take part."""
    x = F.transform(vector_col, lambda e: e.cast("double"))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), x.alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    # Beyond 2**52 a double is whole already; floor() goes by way of a long.
    top = float(np.finfo(np.float64).max)
    scaled = lambda e: F.greatest(F.lit(-top), F.least(F.lit(top), e * scale))
    whole = lambda e: F.when(F.abs(e) < 2.0**52, F.floor(F.when(F.abs(e) < 2.0**52, e)).cast("double")).otherwise(e)
    return rows.select("row", "id", F.transform(F.transform("v", scaled), whole).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``is_query`` (an expression over column id) holds."""
    scratch = Scratch()
    rows = quantized(vectors, id_col, vector_col, scale).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))
    rows = scratch.cut(rows, "topk-rows")
    n = rows.count()
    lanes = min(LANES, max(1, -(-n // SLAB)))
    # Lane edges are quantiles of a bounded sketch of lengths; what an edge cuts off wrongly costs time, not results.
    edges = rows.approxQuantile("norm", [1 - i / lanes for i in range(1, lanes)], 1e-3) if lanes > 1 else []
    lane = F.lit(0)
    for e in sorted(set(edges), reverse=True):
        lane = lane + (F.col("norm") < e).cast("int")
    laned = rows.withColumn("lane", lane)
    # At most LANES rows: how many vectors a lane holds, and the length of its longest.
    held = sorted(laned.groupBy("lane").agg(F.count("*").alias("m"), F.max("norm").alias("top")).collect(), key=lambda r: r["lane"])
    parts, base, number, longest = {}, 0, F.lit(0), []
    for r in held:
        parts[r["lane"]] = -(-r["m"] // SLAB)
        number = F.when(F.col("lane") == r["lane"], F.lit(base) + F.pmod(F.xxhash64("row"), F.lit(parts[r["lane"]]))).otherwise(number)
        base += parts[r["lane"]]
        longest.append((base, r["top"]))
    slab = laned.select(number.cast("int").alias("slab"), F.struct("row", "id", "v").alias("x"))
    slab = slab.groupBy("slab").agg(F.collect_list("x").alias("slab_rows")).mapInArrow(_packed, "number int, pack binary").toDF("slab", "slab_rows")
    slab = scratch.cut(slab, "topk-slabs")
    asked = rows.where(is_query)

    def meet(queries: DataFrame, slab_from: int) -> DataFrame:
        """queries: with floor, and until: the number of slabs that can hold its best."""
        sizes = {r["until"]: r["m"] for r in queries.groupBy("until").agg(F.count("*").alias("m")).collect()}
        blocks = F.lit(1)
        for until, m in sizes.items():
            blocks = F.when(F.col("until") == until, F.lit(max(1, -(-m // BLOCK)))).otherwise(blocks)
        block = F.pmod(F.xxhash64("row", F.lit(1)), blocks).cast("int")
        packed = queries.where(F.col("until") > slab_from).groupBy("until", block.alias("block")).agg(F.collect_list(F.struct("row", "id", "v", "floor")).alias("asks"))
        packed = packed.select("until", "asks").mapInArrow(_packed, "number int, pack binary").toDF("until", "asks")
        packed = scratch.cut(packed.withColumn("number", F.monotonically_increasing_id()), "topk-blocks")
        # By size either table may look fit for a broadcast, which the driver would hold whole: the product reads both from files.
        sides = slab.where(F.col("slab").between(slab_from, max(sizes, default=0) - 1)).coalesce(SIDES)
        met = sides.hint("shuffle_replicate_nl").join(packed, F.col("slab") < F.col("until"))
        return met.select("number", "asks", "slab", "slab_rows").mapInArrow(lambda it: _cells(it, k), "query long, query_id long, id long, score long")

    first = scratch.cut(meet(asked.select("row", "id", "v", F.lit(None).cast("long").alias("floor"), F.lit(1).alias("until")), 0), "topk-first")
    found = first
    if base > 1:
        floors = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        met = asked.join(floors, asked["row"] == floors["query"], "left").drop("query")
        # A lane is needed unless its longest vector falls short of the floor even at cosine 1.
        need = F.when(F.col("floor") > 0, F.col("floor") / F.col("norm") * (1 - 1e-12))
        until = F.lit(longest[0][0])
        for upto, top in longest:
            until = F.when(need.isNull() | F.isnan(need) | (need <= top), F.lit(upto)).otherwise(until)
        met = scratch.cut(met.select("row", "id", "v", "floor", until.alias("until")), "topk-asked")
        found = first.unionByName(meet(met, 1))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best_ = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
    return scratch.last(best_, "topk-found")
