"""Writers for readings and the alert outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_readings(
    df: DataFrame, path: str, device: str = "device_id", ts: str = "ts", mode: str = "overwrite"
) -> None:
    """Readings by date folder, sorted by device and time.

    Ranges of (date, device, time) spread a busy date or device over several writers and keep the
    number of files per folder small. Overwriting replaces the dates that occur in ``df`` and leaves others.
    """
    (
        df.withColumn("date", F.to_date(ts))
        .repartitionByRange("date", device, ts)
        .sortWithinPartitions("date", device, ts)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def read_readings(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Readings of a date range; the range selects folders."""
    df = spark.read.parquet(path)
    if first:
        df = df.filter(F.col("date") >= F.lit(first).cast("date"))
    if last:
        df = df.filter(F.col("date") <= F.lit(last).cast("date"))
    return df


def write_alert_outbox(alerts: DataFrame, path: str) -> None:
    """One row per alert handed to the mailer."""
    alerts.write.mode("append").parquet(path)


def write_outbox_batch(alerts: DataFrame, batch_id: int, path: str) -> None:
    """Streaming form: a micro-batch owns one folder, so running it again replaces its rows."""
    alerts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_bucketed_readings(
    df: DataFrame, name: str, buckets: int, device: str = "device_id", ts: str = "ts", path: str | None = None
) -> None:
    """Readings as a catalog table in buckets of devices, each sorted by device and time.

    What works per device (the reading before, hourly sums, joins on the device) finds the rows of a device together, so it
    needs no shuffle. All rows of a device are in one bucket; a device with more rows than a task can sort should be
    written by ``write_readings``, whose ranges cut it.
    """
    writer = df.repartition(buckets, device).sortWithinPartitions(device, ts).write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)  # else below the warehouse
    writer.bucketBy(buckets, device).sortBy(device, ts).saveAsTable(name)
