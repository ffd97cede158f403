"""Streaming queries: all available input is processed, and the stored rows are returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions.times import iso
from wattledger.plans.alerting import COOLDOWN_SQL
from wattledger.plans.metering import INTERVAL_SQL
from wattledger.plans.registry import query
from wattledger.plans.tables import ISO, READINGS_SQL, level
from wattledger.session import shared_dir
from wattledger.streaming.carry import Carried, cooldown_step, interval_energy_step, run_carried
from wattledger.streaming.energy import hourly_sums
from wattledger.streaming.ordered import InOrder, cooldown_in_order, energy_in_order, run_in_order, run_to_outbox
from wattledger.streaming.run import stream_events


# Micro-batches of the batch operators may be large, as these cut large keys.
LARGE_BATCH = 256 << 30


@query(
    f"""WITH {READINGS_SQL}, m AS (SELECT MAX(ts) - INTERVAL 10 MINUTE AS mark FROM r)
SELECT device_id, strftime(date_trunc('hour', ts), {ISO}) AS slot, CAST(SUM(kwh) AS DOUBLE) AS kwh, COUNT(*) AS n_readings
FROM r CROSS JOIN m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2"""
)
def stream_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Closed hours only: the last hour stays open until ten minutes after its end."""
    rows = stream_events(spark, folder).select(
        F.col("user_id").alias("device_id"), "ts", F.col("value").cast("decimal(18,2)").alias("kwh")
    )
    stored = hourly_sums(rows, ["device_id"]).filter("is_closed")
    return stored.select("device_id", iso(F.col("slot_ts")).alias("slot"), F.col("kwh").cast("double").alias("kwh"), "n_readings")


STREAM_INTERVAL_SQL = (
    INTERVAL_SQL
    + """SELECT event_id, device_id, interval_seconds, kwh_interval_kwh,
  CASE WHEN interval_seconds IS NULL THEN NULL WHEN kwh_interval_kwh > 0 THEN kwh_interval_kwh
    ELSE power_w / CAST(1000 AS DOUBLE) * interval_seconds / CAST(3600 AS DOUBLE) END AS energy_final_kwh
FROM f"""
)
INTERVAL_COLUMNS = ["event_id", "device_id", "interval_seconds", "kwh_interval_kwh", "energy_final_kwh"]


def _counters(spark: SparkSession, folder: str, **limits: int) -> DataFrame:
    return stream_events(spark, folder, **limits).select(
        "event_id", F.col("user_id").alias("device_id"), "ts", F.col("value").alias("kwh_total"), level().cast("double").alias("power_w")
    )


def _alerts(spark: SparkSession, folder: str, **limits: int) -> DataFrame:
    kind = F.when(F.col("value") >= 80, F.lit("critical")).when(F.col("value") >= 40, F.lit("warning"))
    return stream_events(spark, folder, **limits).select("event_id", F.col("user_id").alias("household"), "ts", kind.alias("alert_type"))


# Meters and the mailer may deliver up to a billing period and a half late; what comes later still has no result.
LATENESS = "45 days"
BUCKET = "15 days"  # rows that are released, and sorted, together
CARRIED_LATENESS = "10 days"


def _whole(done: InOrder | Carried) -> DataFrame:
    """Results, and the late rows without one."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in done.rows.schema.fields if f.name not in done.late.columns]
    return done.rows.unionByName(done.late.select("*", *missing).select(*done.rows.columns))


@query(STREAM_INTERVAL_SQL)
def stream_interval_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Readings wait in state until the watermark has passed them; event-time timers release them in order."""
    operator = lambda rows: energy_in_order(rows, LATENESS, max_gap_seconds=86400, bucket=BUCKET)
    return _whole(run_in_order(_counters(spark, folder), operator, "stream-interval")).select(*INTERVAL_COLUMNS)


@query(STREAM_INTERVAL_SQL)
def stream_interval_carried(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the batch operator on micro-batches, which spreads large devices: the newest reading per device is
    carried from one to the next, and to the rest when the input ends."""
    rows = _counters(spark, folder, max_bytes_per_trigger=LARGE_BATCH)
    return _whole(run_carried(rows, interval_energy_step(86400), "carried-interval", lateness=CARRIED_LATENESS)).select(*INTERVAL_COLUMNS)


def _cooldown_columns(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "household", iso(F.col("ts")).alias("at"), "alert_type", "is_sent")


@query(COOLDOWN_SQL)
def stream_cooldown(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts wait in state until the watermark has passed them; event-time timers release them in order."""
    operator = lambda rows: cooldown_in_order(rows, LATENESS, bucket=BUCKET)
    return _cooldown_columns(_whole(run_in_order(_alerts(spark, folder), operator, "stream-cooldown")))


@query(COOLDOWN_SQL)
def stream_cooldown_carried(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the batch operator on micro-batches: the last sent alert per household is carried on."""
    rows = _alerts(spark, folder, max_bytes_per_trigger=LARGE_BATCH)
    done = run_carried(rows, cooldown_step(), "carried-cooldown", lateness=CARRIED_LATENESS)
    return _cooldown_columns(_whole(Carried(done.rows, done.late.where("alert_type IS NOT NULL"))))


@query(f'SELECT event_id, household, "at", alert_type FROM ({COOLDOWN_SQL}) WHERE is_sent')
def stream_outbox(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts that pass the cooldown, streamed into an outbox that holds each once, and read from it."""
    target = shared_dir(spark, "stream-outbox")
    operator = lambda rows: cooldown_in_order(rows, LATENESS, bucket=BUCKET).where("is_sent").select("event_id", "household", "ts", "alert_type")
    sent = run_to_outbox(_alerts(spark, folder), operator, target, keys=("household", "ts", "event_id"))
    return sent.select("event_id", "household", iso(F.col("ts")).alias("at"), "alert_type")
