"""Deterministic sampling, splitting and mixing by hashes of keys. Rank by hash is the draw: no seed state, no row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: Column | str) -> Column:
    """A hexadecimal draw that any engine with SHA-256 reproduces: of "seed:key:key"."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


def placed(rows: DataFrame, d: Column, key: str, *within: str) -> DataFrame:
    """Adds place, from 1, by a draw, ties by key; over all rows or within groups.

    Draws are even, so their first four digits cut the rows into parts of like size: each is ranked by itself, after those
    before it are counted. No task holds all rows, or all of a group.
    """
    parted = rows.withColumns({"__d": d, "__part": F.left(d, F.lit(4))})
    sizes = parted.groupBy(*within, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    nth = F.row_number().over(Window.partitionBy(*within, "__part").orderBy("__d", key))
    ranked = parted.withColumn("__nth", nth)
    on = ranked["__part"] == sizes["__part"]
    for g in within:
        on = on & ranked[g].eqNullSafe(sizes[g])
    return ranked.join(sizes, on).select(*[ranked[c] for c in rows.columns], (F.col("__before") + F.col("__nth")).alias("place"))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by their draw."""
    return placed(rows, draw(seed, key), key).where(F.col("place") <= n).drop("place")


def per_group(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group by their draw; the rank's bound is applied before the shuffle."""
    w = Window.partitionBy(group).orderBy(draw(seed, key), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def group_split(rows: DataFrame, group: str, seed: int, valid: float = 0.1, test: float = 0.1) -> DataFrame:
    """(group, split): groups stay whole. At three groups or more every side has one."""
    names = rows.select(group).where(F.col(group).isNotNull()).distinct()
    n = names.count()
    cut = lambda share: max(1, round(n * share)) if n >= 3 else int(n * share)
    n_test, n_valid = cut(test), cut(valid)
    split = F.when(F.col("place") <= n_test, "test").when(F.col("place") <= n_test + n_valid, "valid").otherwise("train")
    return placed(names, draw(seed, group), group).select(group, split.alias("split"))


def stratified_holdout(rows: DataFrame, stratum: str, group: str, seed: int, share: float = 0.8) -> DataFrame:
    """(stratum, group, split) of groups, per stratum max(1, round(n (1 - share))) held out and one at least left."""
    names = rows.select(stratum, group).distinct()
    sizes = names.groupBy(stratum).agg(F.count("*").alias("n"))
    ranked = placed(names, draw(seed, group), group, stratum).join(sizes, stratum)
    out = F.least(F.greatest(F.lit(1), F.round(F.col("n") * (1 - share)).cast("int")), F.col("n") - 1)
    return ranked.select(stratum, group, F.when(F.col("place") <= out, "evaluation").otherwise("train").alias("split"))


def virtual_epoch(rows: DataFrame, key: str, target: int, seed: int) -> DataFrame:
    """``target`` rows: whole passes over the source, each in its own order, the last one cut short."""
    n = rows.count()
    if not n:
        return rows.withColumn("cycle", F.lit(0)).limit(0)
    full, rest = divmod(target, n)
    last = placed(rows, draw(seed, F.lit(full), key), key).where(F.col("place") <= rest).drop("place").withColumn("cycle", F.lit(full))
    if not full:
        return last
    whole = rows.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(full - 1))))
    return whole.unionByName(last)


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct on keys, the first by order stays: an aggregate that combines before the shuffle, so hot keys don't hurt."""
    packed = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.min_by(packed, order).alias("x")).select(*keys, "x.*")


def feasible_mix(sizes: DataFrame, source: str, count: str, ratios: dict[str, float]) -> DataFrame:
    """(source, take): the largest total that the ratios allow, what rounding leaves to the largest share."""
    table = sizes.sparkSession.createDataFrame(list(ratios.items()), f"{source} string, ratio double")
    met = sizes.join(F.broadcast(table), source)
    whole = Window.partitionBy()
    total = F.floor(F.min(F.col(count) / F.col("ratio")).over(whole))
    rounded = met.withColumn("total", total).withColumn("take", F.floor(F.col("total") * F.col("ratio")).cast("long"))
    left = F.col("total") - F.sum("take").over(whole)
    top = F.row_number().over(Window.orderBy(F.desc("ratio"), source)) == 1
    return rounded.select(source, F.when(top, F.col("take") + left).otherwise(F.col("take")).cast("long").alias("take"))


def leaks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides of a split; must be empty."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says, numbered from 1 in column copy; none for 0."""
    return rows.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))


def oversampled(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """All rows first, then rows drawn again until there are ``count``; column oversampled tells which.

    Draws come in whole passes over the rows, so that none is drawn twice more than another.
    """
    n = rows.count()
    base = rows.withColumn("oversampled", F.lit(False))
    if not n or count <= n:
        return base
    return base.unionByName(virtual_epoch(rows, key, count - n, seed).drop("cycle").withColumn("oversampled", F.lit(True)))


def weighted_pair(a: DataFrame, b: DataFrame, key: str, weight_a: float, weight_b: float, seed: int) -> DataFrame:
    """Rows of two sources by weight, as many as the smaller one allows, by their draw; column source tells a from b."""
    n_a, n_b = a.count(), b.count()
    whole = min(n_a / weight_a if weight_a else n_b, n_b / weight_b if weight_b else n_a)
    part = lambda rows, weight, name: sample(rows, key, int(whole * weight), seed).withColumn("source", F.lit(name))
    return part(a, weight_a, "a").unionByName(part(b, weight_b, "b"))


def mix_plan(rows: DataFrame, source: str, keep: Column, ratios: dict[str, float], total: int) -> DataFrame:
    """(source, raw, filtered, effective): rows by source, those that pass, and what the mix takes; the last source has the rest."""
    names = list(ratios)
    share = {n: round(total * r) for n, r in ratios.items()}
    share[names[-1]] = total - sum(share[n] for n in names[:-1])
    counts = rows.where(F.col(source).isin(names)).groupBy(source).agg(F.count("*").alias("raw"), F.count_if(keep).alias("filtered"))
    table = rows.sparkSession.createDataFrame(list(share.items()), f"{source} string, effective long")
    return table.join(counts, source, "left").select(source, F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("filtered", F.lit(0)).alias("filtered"), "effective")


def mix_build(rows: DataFrame, source: str, key: str, keep: Column, ratios: dict[str, float], total: int, seed: int) -> DataFrame:
    """The mix that ``mix_plan`` plans: of each source as many passes as it takes; place is the order of the whole by draw."""
    kept = rows.where(keep)
    effective = {r[source]: r["effective"] for r in mix_plan(rows, source, keep, ratios, total).collect()}
    parts = [virtual_epoch(kept.where(F.col(source) == name), key, effective[name], seed) for name in ratios]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    tagged = whole.withColumn("__tag", F.concat_ws(":", key, "cycle"))
    return placed(tagged, draw(seed, "__tag"), "__tag").drop("__tag")
