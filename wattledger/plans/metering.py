"""Queries on meter logs, interval energy, gaps, hourly energy and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions.times import iso
from wattledger.operators.alerts import clamp_thresholds, welcome_mail, welcome_triggers, with_auto_enable
from wattledger.operators.budget import budget_for_hours, effective_settings
from wattledger.operators.normalise import (
    energy_columns,
    fill_gaps,
    gap_report as find_gaps,
    hourly_energy as by_hour,
    interval_energy as between_readings,
    scale_raw,
    with_kilowatts,
    with_power_factor,
)
from wattledger.plans.registry import query
from wattledger.plans.tables import (
    COUNTER_SQL,
    DEVICE_HOURS_SQL,
    HOURS_SQL,
    ISO,
    LEVEL_SQL,
    RAW_SQL,
    READINGS_SQL,
    SETTINGS_SQL,
    counter_readings,
    events,
    level,
    raw_readings,
    readings,
    settings_history,
    table,
)
from wattledger.session import shared_dir
from wattledger.sources.meter_logs import (
    parse_meter_log_v1,
    read_meter_log_v2,
    unify_generations,
    write_meter_log_v2,
)
from wattledger.sources.sample_dataset import parse_sample_dataset, sample_series
from wattledger.sources.settings import latest_settings, read_settings, settings_or_default, upsert_settings
from wattledger.sources.sinks import read_readings, write_readings


@query(
    f"""WITH {READINGS_SQL}
SELECT device_id, appliance, strftime(date_trunc('hour', ts), {ISO}) AS slot, CAST(SUM(kwh) AS DOUBLE) AS kwh,
  COUNT(*) AS n_readings
FROM r GROUP BY 1, 2, 3"""
)
def hourly_energy(spark: SparkSession, folder: str) -> DataFrame:
    hourly = by_hour(readings(spark, folder), ["device_id", "appliance"])
    return hourly.select(
        "device_id", "appliance", iso(F.col("slot_ts")).alias("slot"), F.col("kwh").cast("double").alias("kwh"), "n_readings"
    )


INTERVAL_SQL = f"""WITH {COUNTER_SQL},
l AS (SELECT *, lag(ts) OVER w AS pt, lag(kwh_total) OVER w AS pk FROM c
  WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id)),
i AS (SELECT *, (epoch_us(ts) - epoch_us(pt)) / CAST(1000000 AS DOUBLE) AS secs FROM l),
n AS (SELECT *, (secs IS NULL OR secs > 86400) AS new_run FROM i),
f AS (SELECT *, CASE WHEN NOT new_run THEN secs END AS interval_seconds,
    CASE WHEN NOT new_run THEN ROUND(kwh_total - pk, 6) END AS kwh_interval_kwh FROM n)
"""


@query(
    INTERVAL_SQL
    + """SELECT event_id, device_id, interval_seconds, kwh_interval_kwh,
  power_w / CAST(1000 AS DOUBLE) * interval_seconds / CAST(3600 AS DOUBLE) AS energy_fallback_kwh,
  CASE WHEN interval_seconds IS NULL THEN NULL WHEN kwh_interval_kwh > 0 THEN kwh_interval_kwh
    ELSE power_w / CAST(1000 AS DOUBLE) * interval_seconds / CAST(3600 AS DOUBLE) END AS energy_final_kwh,
  CAST(SUM(CASE WHEN new_run THEN 1 ELSE 0 END)
    OVER (PARTITION BY device_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id
FROM f"""
)
def interval_energy(spark: SparkSession, folder: str) -> DataFrame:
    out = between_readings(
        counter_readings(spark, folder), tie=["event_id"], max_gap_seconds=86400, run_ids=True
    )
    return out.select(
        "event_id", "device_id", "interval_seconds", "kwh_interval_kwh", "energy_fallback_kwh",
        "energy_final_kwh", F.col("run_id").cast("bigint").alias("run_id"),
    )


@query(
    f"""WITH {RAW_SQL},
v AS (SELECT event_id, voltage_raw * CAST(0.1 AS DOUBLE) AS voltage_v, current_raw * CAST(0.01 AS DOUBLE) AS current_a,
    power_raw * CAST(0.1 AS DOUBLE) AS power_w, add_ele_raw * CAST(0.01 AS DOUBLE) AS kwh_total FROM m)
SELECT *, power_w / CAST(1000 AS DOUBLE) AS power_kw,
  CASE WHEN voltage_v * current_a = 0 THEN 0.0 ELSE power_w / (voltage_v * current_a) END AS pf_est
FROM v"""
)
def pf_estimate(spark: SparkSession, folder: str) -> DataFrame:
    out = with_kilowatts(with_power_factor(scale_raw(raw_readings(spark, folder))))
    return out.select("event_id", "voltage_v", "current_a", "power_w", "kwh_total", "power_kw", "pf_est")


@query(
    f"""WITH {COUNTER_SQL},
l AS (SELECT device_id, ts, lag(ts) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS pt FROM c),
i AS (SELECT device_id, pt, ts, CAST(floor((epoch_us(ts) - epoch_us(pt)) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS seconds
  FROM l WHERE pt IS NOT NULL),
o AS (SELECT device_id, seconds, row_number() OVER (PARTITION BY device_id ORDER BY seconds) AS rn,
    COUNT(*) OVER (PARTITION BY device_id) AS n FROM i),
m AS (SELECT device_id, seconds AS cadence_seconds FROM o WHERE rn = (n + 1) // 2)
SELECT i.device_id, strftime(pt, {ISO}) AS gap_start, strftime(ts, {ISO}) AS gap_end, seconds, cadence_seconds,
  CAST(floor(seconds / CAST(greatest(cadence_seconds, 1) AS DOUBLE)) AS BIGINT) - 1 AS missed_slots
FROM i JOIN m USING (device_id) WHERE seconds > 3 * greatest(cadence_seconds, 1)"""
)
def gap_report(spark: SparkSession, folder: str) -> DataFrame:
    return find_gaps(counter_readings(spark, folder), tie=["event_id"], factor=3.0).select(
        "device_id", iso(F.col("gap_start")).alias("gap_start"), iso(F.col("gap_end")).alias("gap_end"),
        "seconds", "cadence_seconds", "missed_slots",
    )


@query(
    f"""WITH {DEVICE_HOURS_SQL},
g AS (SELECT device_id, unnest(generate_series(min(slot_ts), max(slot_ts), INTERVAL 1 HOUR)) AS slot_ts FROM hr GROUP BY 1),
j AS (SELECT g.device_id, g.slot_ts, hr.kwh FROM g LEFT JOIN hr ON g.device_id = hr.device_id AND g.slot_ts = hr.slot_ts)
SELECT device_id, strftime(slot_ts, {ISO}) AS slot, CAST(kwh AS DOUBLE) AS kwh,
  CAST(last_value(kwh IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY slot_ts ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS filled_kwh,
  kwh IS NULL AS is_filled
FROM j"""
)
def gap_fill(spark: SparkSession, folder: str) -> DataFrame:
    filled = fill_gaps(by_hour(readings(spark, folder), ["device_id"]), ["device_id"])
    return filled.select(
        "device_id", iso(F.col("slot_ts")).alias("slot"), F.col("kwh").cast("double").alias("kwh"),
        F.col("filled_kwh").cast("double").alias("filled_kwh"), "is_filled",
    )


@query(
    f"""WITH {RAW_SQL}
SELECT concat('dev', device_id, '-', event_id) AS device_id,
  strftime(date_trunc('second', ts) - INTERVAL 8 HOUR, {ISO}) AS ts_utc,
  voltage_raw, current_raw, power_raw, add_ele_raw,
  CASE event_id % 3 WHEN 1 THEN '' WHEN 2 THEN '0' END AS interval_unnamed, switch_1,
  CASE event_id % 3 WHEN 0 THEN 7 ELSE 8 END AS n_fields
FROM m"""
)
def ragged_log_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as log lines of 7 or 8 fields with an +08:00 time, and parsed back."""
    text = lambda c: F.col(c).cast("string")
    head = F.concat_ws(
        ",",
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")),
        F.concat(F.lit("dev"), text("device_id"), F.lit("-"), text("event_id")),
        *[text(c) for c in ("voltage_raw", "current_raw", "power_raw", "add_ele_raw")],
    )
    layout = F.col("event_id") % 3
    middle = F.when(layout == 0, F.lit(",")).when(layout == 1, F.lit(",,")).otherwise(F.lit(",0,"))
    switch = F.when(F.col("switch_1"), F.lit("True")).otherwise(F.lit("False"))
    lines = raw_readings(spark, folder).select(F.concat(head, middle, switch).alias("value"))
    return parse_meter_log_v1(lines).withColumn("ts_utc", iso(F.col("ts"))).drop("ts")


@query(
    f"""WITH {READINGS_SQL},
p AS (SELECT device_id, hour(ts) AS h, SUM(kwh) AS k FROM r GROUP BY 1, 2),
g AS (SELECT device_id, unnest(range(24)) AS slot FROM (SELECT DISTINCT device_id FROM r)),
v AS (SELECT g.device_id, g.slot, COALESCE(CAST(p.k AS DOUBLE), 0.0) AS kwh FROM g LEFT JOIN p ON p.device_id = g.device_id AND p.h = g.slot)
SELECT device_id, '24hours' AS period, 'lookback' AS segment, 'actual' AS series, CAST(slot AS INTEGER) AS slot, kwh FROM v
UNION ALL SELECT device_id, '8hours', 'forecast', 'ac', CAST(slot AS INTEGER), kwh FROM v WHERE slot < 8"""
)
def sample_series_long(spark: SparkSession, folder: str) -> DataFrame:
    """A sample document per device, built from its energy per hour of day, and read as a long table."""
    hour_sums = [
        F.coalesce(F.sum(F.when(F.hour("ts") == h, F.col("kwh"))).cast("double"), F.lit(0.0)) for h in range(24)
    ]
    by_device = readings(spark, folder).groupBy("device_id").agg(F.array(*hour_sums).alias("profile"))
    sample = F.create_map(
        F.lit("24hours"),
        F.to_json(F.struct(F.struct(F.col("profile").alias("actual")).alias("lookback"))),
        F.lit("8hours"),
        F.to_json(F.struct(F.struct(F.slice("profile", 1, 8).alias("ac")).alias("forecast"))),
    )
    body = F.concat(
        F.lit('{"sampleData": {'),
        F.array_join(F.transform(F.map_entries(sample), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "),
        F.lit("}}"),
    )
    documents = by_device.select("device_id", body.alias("value"))
    return sample_series(parse_sample_dataset(documents), ["device_id"])


METER_COLUMNS_SQL = """voltage_raw * CAST(0.1 AS DOUBLE) AS voltage_v, current_raw * CAST(0.01 AS DOUBLE) AS current_a,
  power_raw * CAST(0.1 AS DOUBLE) AS power_w, add_ele_raw * CAST(0.01 AS DOUBLE) AS kwh_total"""


@query(
    f"""WITH {RAW_SQL}, x AS (SELECT concat('dev', device_id, '-', event_id) AS device_id, event_id, ts, switch_1, {METER_COLUMNS_SQL} FROM m)
SELECT device_id, strftime(ts, {ISO}) AS ts_utc, switch_1, voltage_v, current_a, power_w, kwh_total,
  power_w / CAST(1000 AS DOUBLE) AS power_kw, 2 AS generation FROM x WHERE event_id % 2 = 0
UNION ALL
SELECT device_id, strftime(date_trunc('second', ts), {ISO}), switch_1, voltage_v, current_a, power_w, kwh_total,
  power_w / CAST(1000 AS DOUBLE), 1 FROM x WHERE event_id % 2 = 1"""
)
def meter_v2_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """One half of the readings goes through a generation-2 CSV, the other through generation-1 lines;
    both are united, stored as dated Parquet and read back with kilowatts."""
    raw = raw_readings(spark, folder).withColumn(
        "device_id", F.concat(F.lit("dev"), F.col("device_id").cast("string"), F.lit("-"), F.col("event_id").cast("string"))
    )
    missing = F.lit(None).cast("double")
    newer = scale_raw(raw.filter(F.col("event_id") % 2 == 0)).withColumnRenamed("ts", "timestamp")
    newer = newer.withColumns(
        {"interval_seconds": missing, "kwh_interval_kwh": missing, "energy_fallback_kwh": missing,
         "energy_final_kwh": missing, "pf_est": missing}
    )
    csv_path = shared_dir(spark, "meter-csv")
    write_meter_log_v2(newer, csv_path)
    older_lines = raw.filter(F.col("event_id") % 2 == 1).select(
        F.concat_ws(
            ",",
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")),
            *[F.col(c).cast("string") for c in ("device_id", "voltage_raw", "current_raw", "power_raw", "add_ele_raw", "switch_1")],
        ).alias("value")
    )
    united = unify_generations(parse_meter_log_v1(older_lines), read_meter_log_v2(spark, csv_path))
    store = shared_dir(spark, "meter-readings")
    write_readings(united, store)
    return with_kilowatts(read_readings(spark, store)).select(
        "device_id", iso(F.col("ts")).alias("ts_utc"), "switch_1", "voltage_v", "current_a", "power_w",
        "kwh_total", "power_kw", "generation",
    )


@query(
    f"""WITH {SETTINGS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY household ORDER BY ts DESC, event_id DESC) AS rn FROM h)
SELECT c_custkey AS household, COALESCE(email_enabled, false) AS email_enabled, COALESCE(email_address, '') AS email_address,
  COALESCE(threshold_approaching, 80) AS threshold_approaching, COALESCE(threshold_critical, 100) AS threshold_critical,
  COALESCE(currency, 'PHP') AS currency
FROM customer LEFT JOIN o ON o.household = c_custkey AND rn = 1"""
)
def settings_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Last save of each household, stored as a table, with defaults for households without one."""
    saved = shared_dir(spark, "settings")
    upsert_settings(settings_history(spark, folder), saved)
    households = table(spark, folder, "customer").select(F.col("c_custkey").alias("household"))
    latest = read_settings(spark, saved).drop("ts", "event_id")
    return settings_or_default(households, latest)


@query(
    f"""WITH {SETTINGS_SQL},
o AS (SELECT *, lag(email_address, 1, '') OVER (PARTITION BY household ORDER BY ts, event_id) AS prev FROM h)
SELECT household, strftime(ts, {ISO}) AS saved_at, email_address, true AS email_enabled,
  'Welcome to the Energy Dashboard!' AS subject, 'Your email has been successfully registered for automated budget alerts.' AS lead
FROM o WHERE email_address <> prev AND email_address LIKE '%@gmail.com'"""
)
def welcome_trigger(spark: SparkSession, folder: str) -> DataFrame:
    found = welcome_triggers(settings_history(spark, folder), tie=["event_id"])
    return welcome_mail(with_auto_enable(found)).select(
        "household", iso(F.col("ts")).alias("saved_at"), "email_address", "email_enabled", "subject", "lead"
    )


@query(
    f"""WITH {SETTINGS_SQL}
SELECT event_id, email_address, COALESCE(lower(email_address) LIKE '%@gmail.com', false) AS email_enabled,
  email_address LIKE '%@gmail.com' AS welcome_allowed
FROM h"""
)
def address_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The two address rules side by side: one ignores case, the other does not."""
    history = with_auto_enable(settings_history(spark, folder))
    return history.select(
        "event_id", "email_address", "email_enabled", F.endswith("email_address", F.lit("@gmail.com")).alias("welcome_allowed")
    )


@query(
    """WITH t AS (SELECT c_custkey AS household, CAST(c_custkey % 141 - 10 AS INTEGER) AS lo,
    CAST(c_nationkey * 6 - 5 AS INTEGER) AS hi FROM customer),
c AS (SELECT household, least(greatest(lo, 0), 119) AS lo, least(greatest(hi, 1), 120) AS hi FROM t)
SELECT household, least(lo, hi - 1) AS low_after_low, hi AS high_after_low, lo AS low_after_high,
  greatest(hi, lo + 1) AS high_after_high FROM c"""
)
def threshold_clamp(spark: SparkSession, folder: str) -> DataFrame:
    low = (F.col("c_custkey") % 141 - 10).cast("int")
    high = (F.col("c_nationkey") * 6 - 5).cast("int")
    return (
        table(spark, folder, "customer")
        .select(
            F.col("c_custkey").alias("household"),
            clamp_thresholds(low, high, "low").alias("a"),
            clamp_thresholds(low, high, "high").alias("b"),
        )
        .select(
            "household",
            F.col("a.approaching").alias("low_after_low"),
            F.col("a.critical").alias("high_after_low"),
            F.col("b.approaching").alias("low_after_high"),
            F.col("b.critical").alias("high_after_high"),
        )
    )


@query(
    """WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 WHEN c_custkey % 4 = 1 THEN NULL
    ELSE CAST(c_nationkey AS DOUBLE) END AS tariff, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS budget FROM customer)
SELECT c_custkey AS household, CASE WHEN tariff IS NOT NULL AND tariff <> 0 THEN tariff ELSE CAST(13.47 AS DOUBLE) END AS effective_tariff,
  COALESCE(budget, 300.0) AS effective_budget,
  COALESCE(budget, 300.0) * (CAST(24 AS DOUBLE) / CAST(720 AS DOUBLE)) AS day_budget
FROM o"""
)
def settings_effective(spark: SparkSession, folder: str) -> DataFrame:
    """Overrides that count only if set and not zero, and the day's share of a monthly budget."""
    key = F.col("c_custkey")
    overrides = table(spark, folder, "customer").select(
        key.alias("household"),
        F.when(key % 4 == 0, F.lit(0.0)).when(key % 4 != 1, F.col("c_nationkey").cast("double")).alias("tariff"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("budget"),
    )
    return effective_settings(overrides, "tariff", "budget").select(
        "household",
        "effective_tariff",
        "effective_budget",
        budget_for_hours(F.col("effective_budget"), 24, 720).alias("day_budget"),
    )
