"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wattledger.session import shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string")) % n


class Scratch:
    """Tables in a new folder below ``spark.checkpoint.dir``: lineage is cut by writing and reading again.

    Every executor can read them, so a lost executor costs no more than its running tasks.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, shared_dir(spark, name), 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{name}-{self.count}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Blobs:
    """Bytes under names in a new folder below ``spark.checkpoint.dir``, written and read by tasks.

    A name is written whole or not at all; a task that is run again finds its bytes there.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.root = shared_dir(spark, name)

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")

    def put(self, name: str, data: bytes) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
            return
        store.create_dir(root, recursive=True)
        beside = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(beside) as out:
            out.write(data)
        store.move(beside, f"{root}/{name}")

    def get(self, name: str) -> bytes:
        store, root = self._store()
        with store.open_input_stream(f"{root}/{name}") as found:
            return found.read()


def release_memory() -> None:
    """Give memory that a task's batches no longer use back to the system; workers are used again by later tasks."""
    pa.default_memory_pool().release_unused()


def sample_labelled(labels: DataFrame, label: str, per_class: int, train: Column, doc_id: str = "doc_id") -> DataFrame:
    """At most ``per_class`` training rows of each class 0 and 1, chosen by a hash of the id, with their weights.

    A document labelled more than once takes the larger label; null labels and ids take no part. The
    weight of a class is its number of rows over its number of chosen rows, so that weighted sums keep
    the true proportions.
    """
    rows = (
        labels.where(train & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    sizes = rows.groupBy("y").agg(F.count("*").alias("n"))
    chosen = None
    for value in (0, 1):
        part = rows.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    weight = (F.greatest(F.lit(1.0), F.col("n") / F.lit(float(per_class)))).alias("w")
    return chosen.join(F.broadcast(sizes), "y").select("doc_id", "y", weight)  # sizes: two rows


def with_column(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of df and one more column."""
    return StructType([*df.schema.fields, *StructType().add(name, kind).fields])
