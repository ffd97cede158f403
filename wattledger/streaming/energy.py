"""Streaming energy: hourly windows and interval energy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wattledger.operators.normalise import energy_columns
from wattledger.session import shared_dir
from wattledger.sources.sinks import write_outbox_batch


def stream_hourly(
    readings: DataFrame, keys: list[str], ts: str = "ts", kwh: str = "kwh", lateness: str = "10 minutes"
) -> DataFrame:
    """Hourly energy per key; an hour is final once the watermark passes its end, later rows are dropped."""
    return (
        readings.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 hour"), *keys)
        .agg(F.sum(kwh).alias("kwh"), F.count(F.lit(1)).alias("n_readings"))
        .select(*keys, F.col("window.start").alias("slot_ts"), "kwh", "n_readings")
    )


def hourly_sums(stream: DataFrame, keys: list[str], ts: str = "ts", kwh: str = "kwh", lateness: str = "10 minutes") -> DataFrame:
    """Hourly energy per key of all available input, with ``is_closed`` once ``lateness`` has passed its end.

    Every micro-batch appends its partial sums; they are added when read. The result does not depend on the
    order of files or the size of micro-batches, and no late reading is lost.
    """
    spark = stream.sparkSession
    target = shared_dir(spark, "hourly-sums")
    parts: list[T.StructType] = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(*keys, F.date_trunc("hour", ts).alias("slot_ts")).agg(
            F.sum(kwh).alias("kwh"), F.count(F.lit(1)).alias("n_readings"), F.max(ts).alias("newest")
        )
        write_outbox_batch(sums, batch_id, f"{target}/sums")
        parts[:] = [sums.schema]

    query = (
        stream.writeStream.option("checkpointLocation", f"{target}/state").foreachBatch(handle).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not parts:
        empty = stream.sparkSession.createDataFrame([], stream.schema)
        found = empty.groupBy(*keys, F.date_trunc("hour", ts).alias("slot_ts")).agg(
            F.sum(kwh).alias("kwh"), F.count(F.lit(1)).alias("n_readings"), F.max(ts).alias("newest")
        )
    else:
        schema = T.StructType([*parts[0].fields, T.StructField("batch_id", T.LongType())])
        found = spark.read.schema(schema).parquet(f"{target}/sums")
    kind = found.schema["kwh"].dataType
    folded = found.groupBy(*keys, "slot_ts").agg(F.sum("kwh").cast(kind).alias("kwh"), F.sum("n_readings").alias("n_readings"))
    mark = found.agg(F.max("newest").cast("string")).first()[0]
    newest = F.lit(mark).cast(found.schema["newest"].dataType)
    closed = F.col("slot_ts") + F.expr("INTERVAL 1 HOUR") + F.expr(f"INTERVAL {lateness}") <= newest
    return folded.withColumn("is_closed", closed)


class _LastReading(StatefulProcessor):
    """Keeps time and counter of a device's newest reading."""

    def __init__(self, max_gap_seconds: float | None, ttl_ms: int | None):
        self.max_gap_seconds = max_gap_seconds
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us bigint, total double", self.ttl_ms)

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:
        self.last.update((int(initial["us"].iloc[0]), float(initial["kwh_total"].iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # One device's rows of one micro-batch; the source's rate limit bounds them.
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        us = pdf["us"].to_numpy(np.int64)
        total = pdf["kwh_total"].to_numpy(float)
        before_us, before_total = us.astype(float), total.copy()
        before_us[1:], before_total[1:] = us[:-1], total[:-1]
        state = self.last.get()
        before_us[0], before_total[0] = (state[0], state[1]) if state is not None else (np.nan, np.nan)
        if state is None or us[-1] >= state[0]:
            self.last.update((int(us[-1]), float(total[-1])))
        seconds = (us - before_us) / 1_000_000.0
        # A reading that arrives after a newer one has no interval.
        keep = seconds >= 0
        if self.max_gap_seconds is not None:
            keep &= seconds <= self.max_gap_seconds
        yield pdf[["event_id", "device_id", "us", "power_w"]].assign(
            interval_seconds=np.where(keep, seconds, np.nan),
            kwh_interval_kwh=np.where(keep, np.round(total - before_total, 6), np.nan),
        )

    def close(self) -> None:
        pass


def stream_interval_energy(
    readings: DataFrame, ts: str = "ts", max_gap_seconds: float | None = None, ttl_ms: int | None = None,
    newest: DataFrame | None = None,
) -> DataFrame:
    """Interval energy on a stream, where ``lag`` is not available.

    Needs event_id, device_id, kwh_total and power_w. State is one value per device in RocksDB; with
    ``ttl_ms`` silent devices are forgotten; such a stream needs a running trigger, as it never has
    nothing left to do. ``newest`` (see ``newest_readings``) starts the state, so
    that a backlog can be processed by the batch operator first.
    """
    schema = T.StructType(
        [
            readings.schema["event_id"],
            readings.schema["device_id"],
            T.StructField("us", T.LongType()),
            T.StructField("power_w", T.DoubleType()),
            T.StructField("interval_seconds", T.DoubleType()),
            T.StructField("kwh_interval_kwh", T.DoubleType()),
        ]
    )
    out = (
        readings.select("event_id", "device_id", F.unix_micros(ts).alias("us"), "kwh_total", "power_w")
        .groupBy("device_id")
        .transformWithStateInPandas(
            statefulProcessor=_LastReading(max_gap_seconds, ttl_ms),
            outputStructType=schema,
            outputMode="Append",
            timeMode="None" if ttl_ms is None else "ProcessingTime",
            initialState=None if newest is None else newest.groupBy("device_id"),
        )
    )
    numbers = {
        c: F.when(~F.isnan(c), F.col(c)) for c in ("interval_seconds", "kwh_interval_kwh")
    }
    return energy_columns(out.withColumns(numbers)).withColumn(ts, F.timestamp_micros("us")).drop("us")


def newest_readings(readings: DataFrame, ts: str = "ts") -> DataFrame:
    """Time and counter of each device's newest reading, the state a stream starts from."""
    return readings.where(F.col(ts).isNotNull()).groupBy("device_id").agg(
        F.unix_micros(F.max(ts)).alias("us"), F.max_by("kwh_total", F.struct(ts, "event_id")).alias("kwh_total")
    )
