"""Micro-batches that run the batch operators and carry one row per key to the next batch.

The state-store forms hand all rows of a key in a micro-batch to one Python call. Here a micro-batch
goes through the batch operators, which cut large keys, so a busy device or a large backlog stays
spread. What the next batch needs (one row per key) is written next to the results under the batch
number; a replayed batch reads the same predecessor and replaces its own files.

Rows wait until they are known to be in order: those older than the newest time seen less ``lateness`` are
processed, later ones wait, and rows that come after their time was processed are kept apart as late. When
the available input ends, what waits is processed too. Without ``lateness`` all rows wait for that end, so the
results do not depend on the order of files or the size of micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.constants import COOLDOWN_HOURS
from wattledger.operators.alerts import alert_cooldown
from wattledger.operators.normalise import interval_energy
from wattledger.operators.ordered import PIECE_ROWS
from wattledger.session import shared_dir
from wattledger.sources.sinks import write_outbox_batch

Step = Callable[[DataFrame, "DataFrame | None"], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Carried:
    """Results of a run, and the rows that came too late to have one."""

    rows: DataFrame
    late: DataFrame


def run_carried(stream: DataFrame, step: Step, name: str, ts: str = "ts", lateness: str | None = None) -> Carried:
    """Process all available input; ``step`` maps (rows, carried) to (results, carried for the next)."""
    spark = stream.sparkSession
    target = shared_dir(spark, name)
    batches: list[int] = []

    def _value(mark: DataFrame) -> Column:
        """The time in a table of one row; as text, so that no time zone of the driver gets between."""
        return F.lit(mark.select(F.col("mark").cast("string")).first()[0]).cast(stream.schema[ts].dataType)

    results_schema: list[T.StructType] = []

    def process(session: SparkSession, ready: DataFrame, batch_id: int) -> None:
        carried = session.read.parquet(f"{target}/carry/batch_id={batch_id - 1}") if batch_id else None
        results, following = step(ready, carried)
        write_outbox_batch(following, batch_id, f"{target}/carry")
        write_outbox_batch(results, batch_id, f"{target}/rows")
        results_schema[:] = [results.schema]

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        write_outbox_batch(batch, batch_id, f"{target}/input")
        batches.append(batch_id)
        if lateness is None:
            return
        read = lambda kind, i: session.read.schema(stream.schema).parquet(f"{target}/{kind}/batch_id={i}")
        # one row: the newest time so far and the time up to which rows were processed before
        fresh = read("input", batch_id)
        newest = fresh.agg(F.max(ts).alias("newest"))
        done = F.lit(None).cast(stream.schema[ts].dataType)
        if batch_id:
            before = session.read.parquet(f"{target}/mark/batch_id={batch_id - 1}")
            newest = newest.unionByName(before.select("newest")).agg(F.max("newest").alias("newest"))
            done = _value(before)
        mark = newest.withColumn("mark", F.greatest(F.col("newest") - F.expr(f"INTERVAL {lateness}"), done))
        write_outbox_batch(mark, batch_id, f"{target}/mark")
        edge = _value(session.read.parquet(f"{target}/mark/batch_id={batch_id}"))
        late = F.coalesce(F.col(ts) <= done, F.lit(False))
        write_outbox_batch(fresh.filter(late), batch_id, f"{target}/late")
        waiting = fresh.filter(~late)
        if batch_id:
            waiting = waiting.unionByName(read("waiting", batch_id - 1))
        in_order = F.coalesce(F.col(ts) <= edge, F.lit(True))
        write_outbox_batch(waiting.filter(~in_order), batch_id, f"{target}/waiting")
        process(session, waiting.filter(in_order), batch_id)

    query = (
        stream.writeStream.option("checkpointLocation", f"{target}/state")
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    if not batches:
        return Carried(step(empty, None)[0], empty)
    if lateness is None:
        rest, last = spark.read.schema(_with_batch(stream.schema)).parquet(f"{target}/input").drop("batch_id"), 0
        late = empty
    else:
        rest, last = spark.read.schema(stream.schema).parquet(f"{target}/waiting/batch_id={max(batches)}"), max(batches) + 1
        late = spark.read.schema(_with_batch(stream.schema)).parquet(f"{target}/late").drop("batch_id")
    process(spark, rest, last)
    return Carried(spark.read.schema(_with_batch(results_schema[0])).parquet(f"{target}/rows").drop("batch_id"), late)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def interval_energy_step(
    max_gap_seconds: float | None = None, ts: str = "ts", piece_rows: int = PIECE_ROWS
) -> Step:
    """Interval energy of device_id, event_id, ``ts``, kwh_total and power_w.

    Its batches must follow each other in time per device, as ``run_carried`` hands them on.
    """

    def step(batch: DataFrame, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = batch.select("event_id", "device_id", ts, "kwh_total", "power_w").withColumn("_fresh", F.lit(True))
        if carried is not None:
            rows = rows.unionByName(carried.withColumn("_fresh", F.lit(False)), allowMissingColumns=True)
        results = interval_energy(
            rows, ts=ts, tie=["_fresh", "event_id"], max_gap_seconds=max_gap_seconds, piece_rows=piece_rows
        )
        newest = rows.groupBy("device_id").agg(
            F.max(ts).alias(ts), F.max_by("kwh_total", F.struct(ts, "_fresh", "event_id")).alias("kwh_total")
        )
        return results.filter("_fresh").drop("_fresh"), newest

    return step


def cooldown_step(
    cooldown_hours: float = COOLDOWN_HOURS, ts: str = "ts", piece_rows: int = PIECE_ROWS
) -> Step:
    """Cooldown of event_id, household, ``ts`` and alert_type.

    The last sent alert is carried: as the first row of the next batch it is sent again in name only
    and sets the state.
    """

    def step(batch: DataFrame, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = batch.select("event_id", "household", ts, "alert_type").withColumn("_fresh", F.lit(True))
        if carried is not None:
            rows = rows.unionByName(carried.withColumn("_fresh", F.lit(False)), allowMissingColumns=True)
        marked = alert_cooldown(
            rows, ts=ts, tie=["_fresh", "event_id"], cooldown_hours=cooldown_hours, piece_rows=piece_rows
        )
        last_sent = (
            marked.filter("is_sent")
            .groupBy("household")
            .agg(F.max(ts).alias(ts), F.max_by("alert_type", F.struct(ts, "_fresh", "event_id")).alias("alert_type"))
        )
        return marked.filter("_fresh").drop("_fresh"), last_sent

    return step
