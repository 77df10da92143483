"""What the corpus operators share: tables, shared scratch tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one that spark.checkpoint.dir names; it is deleted when the application ends.

    A temporary folder serves only a local master: on a cluster, executors don't share it, so there the setting must be made.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(shared := tempfile.mkdtemp(prefix="lexmill-"))
    own = f"{shared}/lexmill-{sc.applicationId}"
    if own not in _made:
        fs, at = _file_system(spark, own)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _made.add(own)
    return own


_made: set[str] = set()


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Cut:
    """A table written to the shared folder and read again: lineage ends there, and a lost executor costs no
    recomputation of what came before. ``drop()`` deletes the files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        fs, at = _file_system(self.spark, self.path)
        fs.delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """A written table that lasts as long as the application."""
    return Cut(df, name).df


class Scratch:
    """The written tables of one call: those that its result does not read are dropped as soon as they have served."""

    def __init__(self):
        self.held: list[Cut] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(Cut(df, name))
        return self.held[-1].df

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """A table that stays; all others of this call go."""
        out = cut(df, name)
        self.drop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """These tables, or all."""
        for c in [c for c in self.held if not tables or any(c.df is t for t in tables)]:
            self.held.remove(c)
            c.drop()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    edges: columns a, b (long). Returns (node, root) for every node but the roots, which are the smallest nodes of
    their components. Each round aggregates minima (combined before the shuffle) and joins them back on tables that
    were written first, so that adaptive execution can split a hub's rows. Self links, repeats and nulls are ignored;
    an empty graph gives an empty table.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    kept = edges.where("a is not null and b is not null and a <> b")
    now = Cut(kept.select(hi.alias("a"), lo.alias("b")).distinct(), name)
    mark = _mark(now.df)
    while mark[0]:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = Cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), name)
        large = Cut(both.where("b > a").join(least.df, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        low = Cut(large.df.groupBy("a").agg(F.min("b").alias("m")), name)
        joined = large.df.join(low.df, "a")
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = Cut(moved.unionByName(low.df.select("a", F.col("m").alias("b"))).distinct(), name)
        for old in (now, least, large, low):
            old.drop()
        now, before, mark = after, mark, _mark(after.df)
        if mark == before:
            break
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set; equal marks mean that a round changed nothing."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
