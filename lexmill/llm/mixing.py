"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source whose target is r times its size wants r copies of each of its documents. Whole parts are taken at once; the
fractions are rounded by pivots: two fractional documents trade word mass, by chance in one direction or the other and
without changing the words expected in sum, until one of them is taken or left. Documents are dealt by hash to groups of
about ``fan`` and folded within each; what each group leaves unsettled, one document at most, goes up to the next level
of the tree, where groups of groups meet. At the root one document per source is left, which is rounded to nearest, so a
source misses its target by at most half of one document's words. A source that holds a third of all rows has a third
of the groups. Chance is a hash of ids and the seed: reruns agree.

Defined cases: a null text has size 0; documents of size 0 take 0 words, and a source of size 0 has target 0; a null
source is a source of its own, last in order; rows that repeat id, source and size are rounded as one item of that many
copies, and share the copies evenly; an empty table gives no rows. Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut

WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, n, target) by filling: shares by weight, held at ``cap`` times a source's size.

    Sources fill in order of the level at which they reach their cap. Those whose caps lie below the level that the rest
    would share are held there. One row per source passes through the ordered windows, never one per document.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int") + 1).cast("long")
    ranked = by_source.withColumn("w", w)
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = F.col("source_size") * cap
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(full).over(upto), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    levels = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    # Up to the first source that its cap doesn't hold, the levels say who is held; from there on all share its level.
    first = F.min(F.when(full >= F.col("level") * F.col("w"), F.struct("place", "level"))).over(whole)
    shared = levels.withColumn("first", first)
    filled = F.least(full.cast("double"), F.col("w") * F.col("first.level"))
    target = F.when(F.col("place") >= F.col("first.place"), filled).otherwise(full.cast("double"))
    return shared.select("source", "source_size", "n", F.coalesce(target, F.lit(0.0)).alias("target"))


def _uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) from a hash."""
    h = F.xxhash64(*[F.lit(x) if isinstance(x, int) else x for x in parts])
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def _fold(items: Column, start: Column, seed: int, level: int) -> Column:
    """struct(done: items settled, with pick 0 or 1; left: the item that is still fractional, or null)."""
    settled = lambda x, pick: F.struct(x["item"].alias("item"), F.lit(pick).alias("pick"))
    moved = lambda x, p: F.struct(x["item"].alias("item"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))

    def merge(acc: Column, nxt: Column) -> Column:
        cur = acc["left"]
        a, b = cur["item"]["size"].cast("double"), nxt["item"]["size"].cast("double")
        p, q = cur["p"], nxt["p"]
        up, down = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))
        # The mass goes up to ``cur`` with the chance that keeps every document's expectation.
        rise = _uniform(cur["item"]["id"], nxt["item"]["id"], cur["item"]["size"], nxt["item"]["size"], seed, level) * (up + down) < down
        rise = rise | (up == 0)
        took = a * (1 - p) <= b * q
        left = a * p <= b * (1 - q)
        add = lambda done, rest: F.struct(F.concat(acc["done"], F.array(done)).alias("done"), rest.alias("left"))
        return (
            F.when(cur.isNull(), F.struct(acc["done"].alias("done"), nxt.alias("left")))
            .when(rise & took, add(settled(cur, 1), moved(nxt, q - a * (1 - p) / b)))
            .when(rise, add(settled(nxt, 0), moved(cur, p + b * q / a)))
            .when(left, add(settled(cur, 0), moved(nxt, q + a * p / b)))
            .otherwise(add(settled(nxt, 1), moved(cur, p - b * (1 - q) / a)))
        )

    return F.aggregate(items, start, merge)


def copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int, seed: int, fan: int) -> DataFrame:
    """(id, source, size, m, source_size, target, copies): one row per distinct (id, source, size); copies of its m rows."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "mixing-sizes")
    goals = cut(targets(sizes, weights, cap), "mixing-targets")
    ids, sources = sizes.schema["id"].dataType.simpleString(), sizes.schema["source"].dataType.simpleString()
    item = f"struct<id:{ids},source:{sources},size:bigint,m:bigint,base:bigint>"

    distinct = sizes.groupBy("id", "source", "size").agg(F.count("*").alias("m"))
    goal = goals.withColumnRenamed("source", "of")
    wanted = distinct.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    wanted = wanted.withColumn("expect", F.col("m") * rate).withColumn("base", F.floor("expect").cast("long")).withColumn("p", F.col("expect") - F.col("base"))
    wanted = cut(wanted.select(F.struct("id", "source", "size", "m", "base").alias("item"), "p", "n"), "mixing-wanted")
    open_ = (F.col("p") > 0) & (F.col("item.size") > 0)
    done = wanted.where(~open_).select("item", F.lit(0).alias("pick"))
    left = wanted.where(open_).select("item", "p", "n")
    most = goals.agg(F.max("n")).first()[0] or 0
    start = F.expr(f"named_struct('done', cast(array() as array<struct<item:{item},pick:int>>), 'left', cast(null as struct<item:{item},p:double>))")
    level, groups = 0, most
    while groups > 1 or level == 0:
        groups = -(-groups // fan)
        lanes = F.greatest(F.lit(1), F.ceil(F.col("n") / float(fan ** (level + 1)))).cast("long")
        lane = F.pmod(F.xxhash64("item.id", "item.size", F.lit(seed + level)), lanes)
        dealt = left.withColumn("lane", lane).groupBy(F.col("item.source").alias("source"), "lane", "n")
        # Larger documents first: what a group leaves is then mostly small.
        packed = dealt.agg(F.sort_array(F.collect_list(F.struct((-F.col("item.size")).alias("order"), _uniform("item.id", seed + 1000 + level).alias("u"), F.struct("item", "p").alias("x")))).alias("xs"))
        folded = packed.select("n", _fold(F.transform("xs", lambda x: x["x"]), start, seed, level).alias("f"))
        folded = cut(folded, f"mixing-level{level}")
        done = done.unionByName(folded.select(F.explode("f.done").alias("d")).select("d.item", "d.pick"))
        left = folded.where("f.left is not null").select("f.left.item", "f.left.p", "n")
        level += 1
    done = done.unionByName(left.select("item", (F.col("p") >= 0.5).cast("int").alias("pick")))
    out = done.select("item.*", (F.col("item.base") + F.col("pick")).alias("copies")).drop("base")
    return out.join(goal.drop("n"), F.col("source").eqNullSafe(F.col("of"))).drop("of")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 11, fan: int = 64,
) -> DataFrame:
    """One row per input row: (id_col, size, source_size, target, taken, copies, source_col); taken counts repeated words."""
    items = copies(docs, id_col, text_col, source_col, weights, cap, seed, fan)
    rows = items.withColumn("nth", F.explode(F.expr("sequence(1l, m)")))
    own = F.floor(F.col("copies") / F.col("m")) + (F.col("nth") <= F.col("copies") % F.col("m")).cast("long")
    rows = rows.withColumn("own", own)
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("own") * F.col("size")).alias("taken"), F.col("own").alias("copies"), F.col("source").alias(source_col),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with its columns unchanged.

    All is decided on keys; texts meet the decision in one shuffle. Rows that share id, source and size share their copies
    by the hash of their texts, so which text has one more does not depend on the order of rows. Equal texts are numbered
    task by task, so that a text that a third of all rows have is no hot key.
    """
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.withColumns({"__size": size, "__row": F.monotonically_increasing_id()}), "mixing-rows")
    items = copies(rows, id_col, text_col, source_col, **({"weights": (1, 2, 3), "cap": 3, "seed": 11, "fan": 64} | options))
    items = items.groupBy("id", "source", "size").agg(F.sum("m").alias("m"), F.sum("copies").alias("copies"))
    key = F.xxhash64(F.col(id_col).isNull(), id_col, F.col(source_col).isNull(), source_col, "__size")
    told = rows.select("__row", key.alias("key"), F.xxhash64(text_col).alias("hash"), F.shiftright("__row", 33).alias("part"))
    counts = told.groupBy("key", "hash", "part").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("key").orderBy("hash", "part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("key", "hash", "part", F.coalesce(before, F.lit(0)).alias("before"))
    item = items.select(F.xxhash64(F.col("id").isNull(), "id", F.col("source").isNull(), "source", "size").alias("key"), "m", "copies").where("copies > 0")
    nth = F.row_number().over(Window.partitionBy("key", "hash", "part").orderBy("__row"))
    own = F.floor(F.col("copies") / F.col("m")) + (F.col("before") + F.col("nth") <= F.col("copies") % F.col("m")).cast("long")
    taken = told.withColumn("nth", nth).join(counts, ["key", "hash", "part"]).join(item, "key").select("__row", own.alias("__copies")).where("__copies > 0")
    met = rows.join(taken, "__row")
    return met.withColumn("__copy", F.explode(F.expr("sequence(1l, __copies)"))).select(*docs.columns)
