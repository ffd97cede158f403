"""An outbox that holds every alert once, whatever fails or is run again: a streaming and batch sink.

path/files/<id>.parquet      written by tasks, one or more each; in no batch until it is committed
path/commits/<run>/<batch>   manifest of a batch: its files and the number of their rows

Tasks hand their files' names to the driver as commit messages. A batch exists from the moment its manifest gets its
name. If a batch is run again (the stream ended after the commit, before Spark noted it), its manifest is there already
and the new files are dropped; after a failed task the files of the others are dropped. Files whose writer died are in no
manifest, and readers only read what manifests name.

A stream that is started anew, without its checkpoint, is another ``run`` or writes the same batches differently cut.
For that case each row has a key (household and time, unless others are named), and readers keep one row of each key:
the one of the batch committed first.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceStreamArrowWriter,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "alert_outbox"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and path.startswith("file:/"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """The files of one task."""

    files: list[str] = field(default_factory=list)
    rows: int = 0


class _Outbox:
    """Writing and committing, for streams and batches."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.run = options["path"], options.get("run", "default")
        if "/" in self.run or not self.run:
            raise ValueError("a run is a name without slashes")
        self.schema = schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, writer, found, name = Written(), None, None, f"{uuid.uuid4().hex}.parquet"
        store, root = store_of(self.path)
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    store.create_dir(f"{root}/files", recursive=True)
                    found = store.open_output_stream(f"{root}/files/{name}")
                    writer = pq.ParquetWriter(found, batch.schema)
                    out.files.append(name)
                writer.write_batch(batch)
                out.rows += batch.num_rows
        except BaseException:
            if writer is not None:
                found.close()
                store.delete_file(f"{root}/files/{name}")
            raise
        if writer is not None:
            writer.close()
            found.close()
        return out

    def keep(self, messages: list[Written | None], batch: str) -> None:
        store, root = store_of(self.path)
        place = f"{root}/commits/{self.run}/{batch}"
        if store.get_file_info(place).type != fs.FileType.NotFound:
            self.forget(messages)  # a replay
            return
        messages = [m for m in messages if m is not None]
        about = {"run": self.run, "batch": batch, "at": time.time(), "rows": sum(m.rows for m in messages), "files": sorted(f for m in messages for f in m.files)}
        store.create_dir(posixpath.dirname(place), recursive=True)
        beside = f"{posixpath.dirname(place)}/.{uuid.uuid4().hex}"
        with store.open_output_stream(beside) as out:
            out.write(json.dumps(about).encode())
        store.move(beside, place)

    def forget(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{root}/files/{name}")


class OutboxStreamWriter(_Outbox, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.keep(messages, f"{batchId:010d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.forget(messages)


class OutboxWriter(_Outbox, DataSourceArrowWriter):
    """A batch without a name is committed under a new one; a named one counts once."""

    def __init__(self, options: dict[str, str], schema: StructType):
        super().__init__(options, schema)
        self.batch = options.get("batch") or uuid.uuid4().hex

    def commit(self, messages: list[Written | None]) -> None:
        self.keep(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self.forget(messages)


class OutboxSource(DataSource):
    """``df.write`` and ``df.writeStream`` with ``format("alert_outbox")``; options path, run and (batch only) batch."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> OutboxStreamWriter:
        return OutboxStreamWriter(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> OutboxWriter:
        if overwrite:
            raise ValueError("an outbox is only added to")
        return OutboxWriter(self.options, schema)


def register_outbox(spark: SparkSession) -> None:
    spark.dataSource.register(OutboxSource)


def write_outbox(alerts: DataFrame, path: str, run: str = "default", batch: str | None = None) -> None:
    """A batch of alerts. One that has the name of an earlier batch of its run is a repetition and adds nothing."""
    register_outbox(alerts.sparkSession)
    options = {"path": path, "run": run, **({"batch": batch} if batch else {})}
    alerts.write.format(FORMAT).options(**options).mode("append").save()


def stream_to_outbox(alerts: DataFrame, path: str, checkpoint: str, run: str = "default"):
    """The writer of a stream; set its trigger and start it."""
    register_outbox(alerts.sparkSession)
    return alerts.writeStream.format(FORMAT).option("path", path).option("run", run).option("checkpointLocation", checkpoint).outputMode("append")


def outbox_batches(spark: SparkSession, path: str) -> list[dict]:
    """The committed batches, in the order of their commits."""
    store, root = store_of(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/commits", recursive=True, allow_not_found=True))
    out = []
    for info in found:
        if info.type == fs.FileType.File and not info.base_name.startswith("."):
            with store.open_input_stream(info.path) as file:
                out.append(json.loads(file.read()))
    return sorted(out, key=lambda b: (b["at"], b["run"], b["batch"]))


def read_outbox(spark: SparkSession, path: str, schema: StructType | str, keys: tuple[str, ...] = ("household", "ts")) -> DataFrame:
    """One row of every key, from the batch that was committed first (null keys count as equal).

    Repeated rows of one batch and key are ordered by all their columns, so that the result is defined. Without keys
    all committed rows are read.
    """
    batches = outbox_batches(spark, path)
    parts = [(k, f) for k, b in enumerate(batches) for f in b["files"]]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path}/files/{f}" for _, f in parts])
    if not keys:
        return rows
    columns = rows.columns
    order = spark.createDataFrame([(f, k) for k, f in parts], "_file string, _batch int")  # one row per file
    named = rows.withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    values = F.struct("_batch", *[c for c in columns if c not in keys])
    first = named.join(order, "_file").groupBy(*keys).agg(F.min(values).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in columns])
