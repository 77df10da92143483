"""Cached tables of Arrow shards: the newest snapshot of a cache, read a partition a shard.

Paths are of whatever file system pyarrow opens by their address. The driver lists names only; tasks read the shards batch
by batch, and of their columns only those that are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

MARK = "dataset_info.json"  # a snapshot that has been written whole holds it
NUMBERED = re.compile(r"-(\d+)-of-(\d+)\.arrow$")


def newest_snapshot(cache: str, depth: int = 2) -> str:
    """The folder, ``depth`` below the cache, that holds MARK and whose path is the last in order; without any, an error."""
    system, root = fs.FileSystem.from_uri(cache)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    marked = [f.path for f in found if f.is_file and f.base_name == MARK and f.path[len(root) :].strip("/").count("/") == depth]
    if not marked:
        raise FileNotFoundError(f"no snapshot with {MARK} below {cache}")
    return max(marked).rsplit("/", 1)[0]


def shards(snapshot: str, split: str, system: fs.FileSystem) -> list[str]:
    """The split's shards in order. No shard at all is an error, and so is one that the numbers in the names tell is missing."""
    found = system.get_file_info(fs.FileSelector(snapshot))
    named = re.compile(rf"(?:^|.*-){re.escape(split)}-[^/]*\.arrow$")
    paths = sorted(f.path for f in found if f.is_file and named.match(f.base_name))
    if not paths:
        raise FileNotFoundError(f"split {split!r} has no shards in {snapshot}")
    numbers = [NUMBERED.search(p) for p in paths]
    if all(numbers):
        whole, there = int(numbers[0][2]), {int(m[1]) for m in numbers}
        if gone := sorted(set(range(whole)) - there):
            raise FileNotFoundError(f"split {split!r} lacks shards {gone} of {whole} in {snapshot}")
    return paths


class Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ShardReader(DataSourceReader):
    def __init__(self, address: str, paths: list[str], columns: list[str]):
        self.address, self.paths, self.columns = address, paths, columns

    def partitions(self) -> list[Shard]:
        return [Shard(p) for p in self.paths]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.address)
        # The stream's columns that aren't asked for are stepped over, not read into memory.
        with system.open_input_file(partition.path) as f:
            names = pa.ipc.open_stream(f).schema.names
            f.seek(0)
            options = pa.ipc.IpcReadOptions(included_fields=sorted(names.index(c) for c in self.columns))
            for batch in pa.ipc.open_stream(f, options=options):
                yield batch.select(self.columns)


class ArrowShards(DataSource):
    """Format arrow_shards. Options: path (the cache), split, columns (comma-joined; all if left out), depth (of snapshots)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def _found(self) -> tuple[list[str], pa.Schema]:
        cache = self.options["path"]
        snapshot = newest_snapshot(cache, int(self.options.get("depth", "2")))
        system, _ = fs.FileSystem.from_uri(cache)
        paths = shards(snapshot, self.options["split"], system)
        with system.open_input_stream(paths[0]) as f:
            schema = pa.ipc.open_stream(f).schema
        asked = [c for c in self.options.get("columns", "").split(",") if c] or schema.names
        if gone := [c for c in asked if c not in schema.names]:
            raise ValueError(f"columns that the shards lack: {gone}")
        return paths, pa.schema([schema.field(c) for c in asked])

    def schema(self) -> StructType:
        return from_arrow_schema(self._found()[1])

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options["path"], self._found()[0], schema.names)


def cached_split(spark: SparkSession, cache: str, split: str, columns: list[str] | None = None, depth: int = 2) -> DataFrame:
    """The split's rows in the newest snapshot. A shard that is cut off fails the read; nothing is left out."""
    spark.dataSource.register(ArrowShards)
    reader = spark.read.format("arrow_shards").option("split", split).option("depth", str(depth))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(cache)


def standard(rows: DataFrame, dataset: str, split: str) -> DataFrame:
    """Recordings of a cache under common names: source_id, speaker_id, text, dataset, split, duration_seconds (0 or more; null if a time is)."""
    span = F.col("end_time").cast("double") - F.col("begin_time").cast("double")
    held = [c for c in rows.columns if c not in ("segment_id", "speaker", "begin_time", "end_time", "dataset", "split", "duration_seconds", "source_id", "speaker_id")]
    return rows.select(
        *held, F.col("segment_id").alias("source_id"), F.col("speaker").alias("speaker_id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"),
        F.when(span.isNotNull(), F.greatest(F.lit(0.0), span)).alias("duration_seconds"),
    )
