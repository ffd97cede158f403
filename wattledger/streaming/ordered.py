"""Streams held in the order of time by their own state.

Rows of a key wait in state, in buckets of time, until the watermark has passed their bucket: an event-time timer then
releases the bucket, whose rows are sorted and follow what was released before. A row whose bucket is released already is
late; it leaves at once by a second output. What is out of order by less than ``lateness`` is thus put right, whatever
the files and micro-batches, and the input is not stored a second time.

A run over all available input ends with a mark, a row of the far future in a side source, which moves the watermark past
everything, so that all timers fire. A stream that goes on later is not marked.

Keys are dealt by hash to ``groups``, whose state and timers they share: a call to the state store, a timer and a table cost
the same for one key as for hundreds, and there are as many as groups, whatever the number of keys. Rows wait as Arrow
batches; a later part of a bucket is stored beside the others.

Memory: a task holds one bucket of one group. State is in RocksDB, the rows of the last ``lateness`` and one of each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wattledger.constants import COOLDOWN_HOURS
from wattledger.operators.normalise import energy_columns
from wattledger.session import shared_dir
from wattledger.sources.outbox import read_outbox, stream_to_outbox
from wattledger.streaming.run import drain, state_settings, stored_rows

FAR = "9999-01-01 00:00:00"
END = "9000-01-01 00:00:00"  # rows from here on are marks
GROUPS = 4096  # of keys; their number is fixed when a stream starts


@dataclass(frozen=True)
class InOrder:
    """Results of the rows that came in time, and the rows that came too late to have one."""

    rows: DataFrame
    late: DataFrame


class Waiting(StatefulProcessor):
    """Lets rows wait; ``released`` is called with the rows of one bucket after the other, in order.

    State is kept by group of keys, so that its calls and the work on tables are one for many keys.
    """

    def __init__(self, fields: list[T.StructField], bucket_ms: int):
        self.fields, self.bucket_ms = fields, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in self.fields])
        self.waiting = handle.getMapState("waiting", "bucket bigint, part int", "rows binary")
        self.parts = handle.getMapState("parts", "bucket bigint", "n int")
        self.kept = handle.getValueState("kept", "bucket bigint, rows binary")  # the newest bucket, and a row of each key

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            bucket = pdf["us"].to_numpy(np.int64) // (self.bucket_ms * 1000)
            late = ((bucket + 1) * self.bucket_ms <= mark) & (mark > 0)
            if late.any():
                yield self.as_late(pa.Table.from_batches([self._batch(pdf[late])]))
            order = np.argsort(bucket, kind="stable")
            order = order[~late[order]]
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                self._wait(int(bucket[part[0]]), self._batch(pdf.iloc[part]))

    def _batch(self, pdf: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pdf[f.name], f.type, from_pandas=True) for f in self.schema], schema=self.schema)

    def _stored(self, rows: bytes) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(pa.py_buffer(bytes(rows)), self.schema)

    def _expiry(self, bucket: int) -> int:
        return max((bucket + 1) * self.bucket_ms, 1)

    def _wait(self, bucket: int, batch: pa.RecordBatch) -> None:
        """Adds a part to a bucket; what waits already is not touched."""
        found = self.parts.getValue((bucket,))
        n = 0 if found is None else found[0]
        if not n:
            self.handle.registerTimer(self._expiry(bucket))
        self.waiting.updateValue((bucket, n), (batch.serialize().to_pybytes(),))
        self.parts.updateValue((bucket,), (n + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for bucket in sorted(b for (b,) in self.parts.keys() if self._expiry(b) <= now):
            (n,) = self.parts.getValue((bucket,))
            batches = []
            for part in range(n):
                batches.append(self._stored(self.waiting.getValue((bucket, part))[0]))
                self.waiting.removeKey((bucket, part))
            self.parts.removeKey((bucket,))
            yield self._in_order(bucket, pa.Table.from_batches(batches))

    def _in_order(self, bucket: int, fresh: pa.Table) -> pd.DataFrame:
        before, table = self.kept.get(), fresh.append_column("is_new", pa.array(np.ones(fresh.num_rows, bool)))
        if before is not None:
            if bucket < before[0]:
                raise RuntimeError("a bucket was released after a later one")
            kept = pa.Table.from_batches([self._stored(before[1])])
            table = pa.concat_tables([kept.append_column("is_new", pa.array(np.zeros(kept.num_rows, bool))), table])
        table = table.sort_by([(c, "ascending") for c in ("key", "no_key", "is_new", "us", "no_id", "event_id")]).combine_chunks()
        keys = [table[c].combine_chunks() for c in ("key", "no_key")]
        first = np.ones(table.num_rows, bool)  # of its key
        first[1:] = np.logical_or(*(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in keys))
        is_new = table["is_new"].to_numpy()
        out, last = self.released(table.drop_columns("is_new"), first, is_new)
        rest = table.drop_columns("is_new").take(pa.array(last)).combine_chunks().to_batches()
        self.kept.update((bucket, rest[0].serialize().to_pybytes()))
        return out[is_new]

    def as_late(self, table: pa.Table) -> pd.DataFrame:
        raise NotImplementedError

    def released(self, table: pa.Table, first: np.ndarray, is_new: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        """The results of all rows, and the place of the row that is kept of each key.

        A key's rows follow each other, ``first`` is true for the first of them: the kept one (not new) if there is one.
        """
        raise NotImplementedError

    def close(self) -> None:
        pass


def _named(table: pa.Table, key: str, columns: tuple[str, ...]) -> pd.DataFrame:
    """The rows with null in place of the stand-ins."""
    out = {name: pc.if_else(table[null], pa.scalar(None, table[c].type), table[c]) for name, c, null in (("event_id", "event_id", "no_id"), (key, "key", "no_key"))}
    return pa.table(out | {c: table[c] for c in columns}).to_pandas(integer_object_nulls=True)


class _Energy(Waiting):
    """Keeps the newest reading of each device."""

    def __init__(self, fields: list[T.StructField], bucket_ms: int, max_gap_seconds: float | None):
        super().__init__(fields, bucket_ms)
        self.max_gap_seconds = max_gap_seconds

    def _out(self, table: pa.Table, seconds, kwh, late: bool) -> pd.DataFrame:
        rows = _named(table, "device_id", ("us", "kwh_total", "power_w"))
        return rows.assign(interval_seconds=seconds, kwh_interval_kwh=kwh, is_late=late)

    def as_late(self, table):
        return self._out(table, np.nan, np.nan, True)

    def released(self, table, first, is_new):
        us, total = table["us"].to_numpy(), table["kwh_total"].to_numpy().astype(float)
        seconds, kwh = np.full(len(us), np.nan), np.full(len(us), np.nan)
        seconds[1:], kwh[1:] = np.diff(us) / 1_000_000.0, np.round(np.diff(total), 6)
        keep = ~first & (seconds >= 0)
        if self.max_gap_seconds is not None:
            keep &= seconds <= self.max_gap_seconds
        out = self._out(table, np.where(keep, seconds, np.nan), np.where(keep, kwh, np.nan), False)
        return out, np.append(np.flatnonzero(first)[1:], len(us)) - 1


class _Cooldown(Waiting):
    """Keeps the alert that was sent last to each household."""

    def __init__(self, fields: list[T.StructField], bucket_ms: int, cooldown_us: int):
        super().__init__(fields, bucket_ms)
        self.cooldown_us = cooldown_us

    def _out(self, table: pa.Table, sent, late: bool) -> pd.DataFrame:
        return _named(table, "household", ("us", "alert_type")).assign(is_sent=sent, is_late=late)

    def as_late(self, table):
        return self._out(table, None, True)

    def released(self, table, first, is_new):
        sent, last_kind, last_us = [], None, 0  # the kept alert was sent
        for at, kind, start in zip(table["us"].to_pylist(), table["alert_type"].to_pylist(), first.tolist()):
            send = start or kind != last_kind or at - last_us > self.cooldown_us
            if send:
                last_kind, last_us = kind, at
            sent.append(send)
        sent = np.array(sent)
        places = np.where(sent, np.arange(len(sent)), -1)
        return self._out(table, sent, False), np.maximum.reduceat(places, np.flatnonzero(first))


def _standing(rows: DataFrame, column: str, name: str, null: str) -> list[Column]:
    """A stand-in for a null and a mark of it, as pandas has no null integers."""
    kind = rows.schema[column].dataType
    empty = F.lit("").cast(kind) if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
    return [F.coalesce(F.col(column), empty).alias(name), F.col(column).isNull().alias(null)]


def _keyed(rows: DataFrame, key: str) -> list[Column]:
    return [*_standing(rows, key, "key", "no_key"), *_standing(rows, "event_id", "event_id", "no_id")]


def _milliseconds(span: str, spark) -> int:
    return spark.range(1).select(F.expr(f"unix_millis(timestamp_micros(0) + interval {span})")).first()[0]


def _after(stream: DataFrame, ts: str, lateness: str, processor: Callable, schema: T.StructType, columns: list[Column], bucket: str, groups: int) -> DataFrame:
    """The rows after their watermark, through the processor; marks end here."""
    rows = stream.withWatermark(ts, lateness).where(F.col(ts).isNull() | (F.col(ts) < F.lit(END).cast(stream.schema[ts].dataType)))
    # names without a leading underscore, which rows would lose on their way to pandas
    rows = rows.select(*columns)  # ``us`` is no event-time column, so late rows are not dropped before they are seen
    fields = rows.schema.fields
    grouped = rows.withColumn("key_group", F.pmod(F.xxhash64("key", "no_key"), F.lit(groups))).groupBy("key_group")
    return grouped.transformWithStateInPandas(
        statefulProcessor=processor(fields, _milliseconds(bucket, stream.sparkSession)), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def energy_in_order(
    readings: DataFrame, lateness: str, ts: str = "ts", max_gap_seconds: float | None = None, bucket: str = "1 hour", groups: int = GROUPS
) -> DataFrame:
    """Interval energy of event_id, device_id, ``ts``, kwh_total and power_w, with ``is_late``.

    A late row has no interval. A reading without a time is taken as of 1970.
    """
    us = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0)).alias("us")
    schema = T.StructType([
        readings.schema["event_id"], readings.schema["device_id"], T.StructField("us", T.LongType()),
        *(T.StructField(c, T.DoubleType()) for c in ("kwh_total", "power_w", "interval_seconds", "kwh_interval_kwh")), T.StructField("is_late", T.BooleanType()),
    ])
    columns = [*_keyed(readings, "device_id"), us, F.col("kwh_total").cast("double"), F.col("power_w").cast("double")]
    out = _after(readings, ts, lateness, lambda fields, width: _Energy(fields, width, max_gap_seconds), schema, columns, bucket, groups)
    numbers = {c: F.when(~F.isnan(c), F.col(c)) for c in ("kwh_total", "power_w", "interval_seconds", "kwh_interval_kwh")}
    return energy_columns(out.withColumns(numbers)).withColumn(ts, F.timestamp_micros("us")).drop("us")


def cooldown_in_order(
    alerts: DataFrame, lateness: str, ts: str = "ts", cooldown_hours: float = COOLDOWN_HOURS, bucket: str = "1 hour", groups: int = GROUPS
) -> DataFrame:
    """Cooldown of event_id, household, ``ts`` and alert_type, with ``is_late``; rows without an alert are dropped.

    Whether a late alert would have been sent is not known. An alert without a time is taken as of 1970.
    """
    us = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0)).alias("us")
    schema = T.StructType([
        alerts.schema["event_id"], alerts.schema["household"], T.StructField("us", T.LongType()), T.StructField("alert_type", T.StringType()),
        T.StructField("is_sent", T.BooleanType()), T.StructField("is_late", T.BooleanType()),
    ])
    columns = [*_keyed(alerts, "household"), us, F.col("alert_type")]
    rows = _without_kind(alerts, ts)
    out = _after(rows, ts, lateness, lambda fields, width: _Cooldown(fields, width, int(cooldown_hours * 3_600_000_000)), schema, columns, bucket, groups)
    return out.withColumn(ts, F.timestamp_micros("us")).drop("us")


def _without_kind(alerts: DataFrame, ts: str) -> DataFrame:
    """Alerts only; marks have no type either, and stay."""
    return alerts.where(F.col("alert_type").isNotNull() | (F.col(ts) >= F.lit(END).cast(alerts.schema[ts].dataType)))


def _with_marks(stream: DataFrame, target: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a side source for the end mark, and what sets the mark."""
    spark, marks = stream.sparkSession, f"{target}/marks"
    spark.createDataFrame([], stream.schema).write.parquet(marks)

    def end(ts: str = "ts") -> None:
        far = [F.lit(FAR if f.name == ts else None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
        spark.range(1).select(*far).write.mode("append").parquet(marks)

    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(marks)), end


def run_in_order(
    stream: DataFrame, operator: Callable[[DataFrame], DataFrame], name: str, ts: str = "ts", state_partitions: int | None = None
) -> InOrder:
    """All available input through ``operator`` (one of the above), then the end mark; rows and late rows.

    Every micro-batch owns a folder, so a replayed one replaces its rows.
    """
    spark = stream.sparkSession
    target = shared_dir(spark, name)
    marked, end = _with_marks(stream, target)
    out = operator(marked)
    drain(out, target, state_partitions=state_partitions, goes_on=True)
    end(ts)
    drain(out, target, state_partitions=state_partitions)
    rows = stored_rows(spark, target, out.schema)
    return InOrder(rows.where(~F.col("is_late")).drop("is_late"), rows.where("is_late").drop("is_late"))


def run_to_outbox(
    stream: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, ts: str = "ts",
    keys: tuple[str, ...] = ("household", "ts"), state_partitions: int | None = None,
) -> DataFrame:
    """The same into an outbox in ``target``; one row of each key, read from it."""
    marked, end = _with_marks(stream, target)
    out = operator(marked)
    for at_end in (False, True):
        if at_end:
            end(ts)
        with state_settings(stream.sparkSession, state_partitions, goes_on=not at_end):
            stream_to_outbox(out, f"{target}/outbox", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
    return read_outbox(stream.sparkSession, f"{target}/outbox", out.schema, keys)
