"""Running a stream over what is available, into batch folders."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wattledger.schemas import EVENTS
from wattledger.session import ROCKSDB_PROVIDER, shared_dir
from wattledger.sources.sinks import write_outbox_batch


def stream_events(
    spark: SparkSession, folder: str, name: str = "events.parquet",
    max_bytes_per_trigger: int = 1 << 30, max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The event table as a stream, be it one file or a folder of files; a missing table is an error.

    The size of a micro-batch is limited, and with it the rows that one key can bring to a stateful
    operator at once.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    reader = spark.readStream.schema(EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    if status.isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None, goes_on: bool = False) -> Iterator[None]:
    """State in RocksDB; the number of its partitions is fixed when a stream starts, and is the cluster's parallelism.

    A stream that goes on later leaves the timers of its last watermark to the next micro-batch.
    """
    settings = {
        "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(not goes_on).lower(),
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def drain(df: DataFrame, target: str, output_mode: str = "append", state_partitions: int | None = None, goes_on: bool = False) -> None:
    """Process all available input once, from the checkpoint in ``target``, into its batch folders.

    Every micro-batch owns a folder, so a batch that is replayed after a failure replaces its rows.
    """

    def store(rows: DataFrame, batch_id: int) -> None:
        write_outbox_batch(rows, batch_id, f"{target}/rows")

    with state_settings(df.sparkSession, state_partitions, goes_on):
        query = (
            df.writeStream.outputMode(output_mode)
            .option("checkpointLocation", f"{target}/state")
            .foreachBatch(store)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def stored_rows(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The rows of all micro-batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_batch).parquet(f"{target}/rows").drop("batch_id")


def run_available(
    df: DataFrame, name: str, output_mode: str = "append", state_partitions: int | None = None
) -> DataFrame:
    """Process all available input once and return the stored rows."""
    target = shared_dir(df.sparkSession, name)
    drain(df, target, output_mode, state_partitions)
    return stored_rows(df.sparkSession, target, df.schema)
