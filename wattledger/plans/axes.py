"""Queries on time axes and series assembly."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattledger.constants import ACTUAL_BASE, ACTUAL_INCREMENT
from wattledger.functions.numbers import leading_double, leading_int
from wattledger.functions.times import iso, long_date
from wattledger.operators.axis import (
    build_axis,
    day_steps,
    lookback_totals,
    with_period,
    range_totals,
)
from wattledger.operators.cost import load_factor
from wattledger.operators.forecast import seasonal_naive as naive
from wattledger.operators.normalise import hourly_energy
from wattledger.operators.series import (
    appliance_filter,
    appliance_overlay as per_appliance,
    concat_series,
    configured_without_series,
    disaggregate,
    fit_length as fit,
    fixed_share_breakdown as fixed_parts,
    lookup,
    number_slots,
    overlay,
    slot_totals,
    source_priority as pick_source,
)
from wattledger.plans.registry import query
from wattledger.plans.tables import (
    CUTOFF,
    DEVICE_HOURS_SQL,
    HOURS_SQL,
    ISO,
    KINDS,
    LEVEL_SQL,
    READINGS_SQL,
    events,
    level,
    readings,
    table,
)
from wattledger.session import stored

# Ranges of two of the five appliances, a constant for the third; the others have neither.
RANGES = {"view": (2.2, 2.8), "click": (1.1, 1.4)}
CONSTANTS = {"signup": 0.1}
CONFIGURED = [*KINDS, "standby"]


@query(
    """WITH c AS (SELECT c_custkey, TIMESTAMP '2024-01-30 05:00:00' + to_minutes(c_custkey * 37) AS base,
    c_custkey % 5 AS lb, c_nationkey % 9 AS fc FROM customer),
a AS (SELECT c_custkey, base, unnest(generate_series(-greatest(1, lb), greatest(1, fc) - 1)) AS o FROM c)
SELECT c_custkey AS household, CAST(o AS INTEGER) AS offset_h, CASE WHEN o < 0 THEN 'prev' ELSE 'next' END AS segment,
  strftime(base + to_hours(o), '%m/%d/%y %H:%M') AS label, o < 6 AS within_6h
FROM a"""
)
def axis_labels(spark: SparkSession, folder: str) -> DataFrame:
    base = F.lit("2024-01-30 05:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("c_custkey") * 37).cast("int"))
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("household"),
        base.alias("base"),
        (F.col("c_custkey") % 5).alias("lookback"),
        (F.col("c_nationkey") % 9).alias("forecast"),
    )
    axis = build_axis(customers, "base", "forecast", "lookback")
    return axis.select("household", "offset_h", "segment", "label", (F.col("offset_h") < 6).alias("within_6h"))


@query(
    f"""WITH {DEVICE_HOURS_SQL}, b AS (SELECT device_id, MIN(slot_ts) AS base FROM hr GROUP BY 1),
o AS (SELECT hr.device_id, kwh, date_diff('hour', base, slot_ts) AS offset_h FROM hr JOIN b ON b.device_id = hr.device_id),
c AS (SELECT unnest([6, 12, 24]) AS range_h)
SELECT device_id, CAST(range_h AS INTEGER) AS range_h, COUNT(*) AS slots, CAST(SUM(kwh) AS DOUBLE) AS kwh
FROM o JOIN c ON offset_h < range_h GROUP BY 1, 2"""
)
def chart_range(spark: SparkSession, folder: str) -> DataFrame:
    """Hours and energy of every device that the three chart ranges keep, counted from its first hour."""
    hours = hourly_energy(readings(spark, folder), ["device_id"])
    first = Window.partitionBy("device_id")
    apart = F.unix_seconds("slot_ts") - F.unix_seconds(F.min("slot_ts").over(first))
    offsets = hours.withColumn("offset_h", (apart / F.lit(3600)).cast("bigint"))
    return range_totals(offsets, ["device_id"]).withColumn("kwh", F.col("kwh").cast("double"))


@query(
    f"""SELECT o_orderkey, strftime(o_orderdate - INTERVAL 1 DAY, {ISO}) AS prev_date,
  strftime(o_orderdate + INTERVAL 1 DAY, {ISO}) AS next_date, strftime(o_orderdate, '%B %-d, %Y') AS date_label
FROM orders"""
)
def day_shift(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return day_steps(orders, "o_orderdate").select(
        "o_orderkey", iso(F.col("prev_date")).alias("prev_date"), iso(F.col("next_date")).alias("next_date"), "date_label"
    )


@query(
    f"""WITH k AS (SELECT {LEVEL_SQL} AS hours FROM events)
SELECT hours, COUNT(*) AS n,
  CASE hours WHEN 1 THEN '1hour' WHEN 4 THEN '4hours' WHEN 8 THEN '8hours' WHEN 24 THEN '24hours' END AS period_key,
  CASE hours WHEN 1 THEN 'Next 1 Hour' WHEN 4 THEN 'Next 4 Hours' WHEN 8 THEN 'Next 8 Hours' ELSE 'Next 24 Hours' END AS period_text,
  hours IN (1, 4, 8, 24) AS valid_period, hours IN (6, 12, 24) AS valid_range
FROM k GROUP BY 1"""
)
def period_dimension(spark: SparkSession, folder: str) -> DataFrame:
    counts = events(spark, folder).groupBy(level().alias("hours")).agg(F.count(F.lit(1)).alias("n"))
    return with_period(counts, "hours")


@query(
    f"""WITH {READINGS_SQL}, w AS (SELECT unnest([1, 4, 8, 24]) AS lookback_h)
SELECT appliance, lookback_h, CAST(SUM(kwh) AS DOUBLE) AS kwh, COUNT(*) AS n_readings
FROM r JOIN w ON ts >= TIMESTAMP '{CUTOFF}' - to_hours(lookback_h) AND ts < TIMESTAMP '{CUTOFF}'
GROUP BY 1, 2"""
)
def lookback_window(spark: SparkSession, folder: str) -> DataFrame:
    base = datetime.fromisoformat(CUTOFF).replace(tzinfo=timezone.utc)
    return lookback_totals(readings(spark, folder), base, ["appliance"])


@query(
    f"""WITH {READINGS_SQL},
d AS (SELECT device_id, appliance, date_trunc('day', ts) AS day, SUM(kwh) AS k FROM r GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY device_id, appliance ORDER BY day) - 1 AS slot FROM d),
v AS (SELECT device_id, appliance, slot, CASE WHEN CAST(k AS DOUBLE) >= 1 THEN CAST(k AS DOUBLE) END AS k FROM n),
l AS (SELECT device_id, appliance, MAX(slot) AS last FROM v WHERE slot < 10 GROUP BY 1, 2),
g AS (SELECT c_custkey AS device_id, appliance, unnest(range(10)) AS slot
  FROM customer CROSS JOIN (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS appliance))
SELECT g.device_id, g.appliance, CAST(g.slot AS INTEGER) AS slot, g.slot > COALESCE(last, -1) AS is_extended,
  CASE WHEN g.slot > COALESCE(last, -1) THEN CAST(4.2 AS DOUBLE) + g.slot * CAST(0.15 AS DOUBLE) ELSE k END AS kwh
FROM g LEFT JOIN v ON v.device_id = g.device_id AND v.appliance = g.appliance AND v.slot = g.slot
LEFT JOIN l ON l.device_id = g.device_id AND l.appliance = g.appliance"""
)
def fit_length(spark: SparkSession, folder: str) -> DataFrame:
    """Ten days of every customer and appliance, with or without readings; days below 1 kWh are unknown inside."""
    keys = ["device_id", "appliance"]
    daily = readings(spark, folder).groupBy(*keys, F.to_date("ts").alias("day")).agg(F.sum("kwh").cast("double").alias("kwh"))
    numbered = number_slots(daily, keys, "day").withColumn("kwh", F.when(F.col("kwh") >= 1, F.col("kwh")))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("device_id"))
    axis = customers.withColumn("appliance", F.explode(F.array(*map(F.lit, KINDS))))
    return fit(numbered, keys, 10, ACTUAL_BASE, ACTUAL_INCREMENT, axis=axis)


@query(
    f"""WITH {HOURS_SQL},
s AS (SELECT device_id, appliance, CAST(SUM(kwh) AS DOUBLE) / COUNT(*) AS m FROM hr GROUP BY 1, 2),
g AS (SELECT c_custkey AS device_id, unnest(['view', 'click', 'purchase', 'signup', 'error', 'standby']) AS appliance FROM customer),
j AS (SELECT g.device_id, g.appliance, s.m,
    CASE g.appliance WHEN 'view' THEN (CAST(2.2 AS DOUBLE) + CAST(2.8 AS DOUBLE)) / 2 WHEN 'click' THEN (CAST(1.1 AS DOUBLE) + CAST(1.4 AS DOUBLE)) / 2 END AS mid,
    CASE g.appliance WHEN 'signup' THEN CAST(0.1 AS DOUBLE) END AS con
  FROM g LEFT JOIN s ON s.device_id = g.device_id AND s.appliance = g.appliance)
SELECT device_id, appliance, COALESCE(m, mid, con) AS kwh,
  CASE WHEN m IS NOT NULL THEN 'sample' WHEN mid IS NOT NULL THEN 'range' WHEN con IS NOT NULL THEN 'constant' END AS source
FROM j"""
)
def source_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly level of every configured appliance: measured, else middle of its range, else constant."""
    keys = ["device_id", "appliance"]
    hourly = hourly_energy(readings(spark, folder), keys)
    sample = hourly.groupBy(*keys).agg((F.sum("kwh").cast("double") / F.count(F.lit(1))).alias("sample"))
    wanted = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("device_id"), F.explode(F.array(*[F.lit(a) for a in CONFIGURED])).alias("appliance")
    )
    joined = wanted.join(sample, keys, "left")
    return pick_source(joined, "sample", RANGES, constants=CONSTANTS).select(*keys, "kwh", "source")


@query(
    f"""WITH {HOURS_SQL},
f AS (SELECT device_id, appliance, slot_ts + INTERVAL 24 HOUR AS slot_ts, kwh FROM hr)
SELECT COALESCE(hr.device_id, f.device_id) AS device_id, COALESCE(hr.appliance, f.appliance) AS appliance,
  strftime(COALESCE(hr.slot_ts, f.slot_ts), {ISO}) AS slot, CAST(hr.kwh AS DOUBLE) AS actual_kwh, CAST(f.kwh AS DOUBLE) AS forecast_kwh,
  CASE WHEN COALESCE(hr.slot_ts, f.slot_ts) < TIMESTAMP '{CUTOFF}' THEN 'prev' ELSE 'next' END AS segment
FROM hr FULL JOIN f ON hr.device_id = f.device_id AND hr.appliance = f.appliance AND hr.slot_ts = f.slot_ts"""
)
def actual_forecast_overlay(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["device_id", "appliance"]
    hourly = hourly_energy(readings(spark, folder), keys)
    both = overlay(hourly, naive(hourly, keys), keys)
    segment = F.when(F.col("slot_ts") < F.lit(CUTOFF).cast("timestamp"), F.lit("prev")).otherwise(F.lit("next"))
    return both.select(
        *keys, iso(F.col("slot_ts")).alias("slot"), "actual_kwh", "forecast_kwh", segment.alias("segment")
    )


WEIGHTS_SQL = """w AS (SELECT device_id, appliance, CAST(SUM(kwh) AS DOUBLE) AS app_kwh FROM r GROUP BY 1, 2),
t AS (SELECT device_id, CAST(SUM(kwh) AS DOUBLE) AS total FROM r GROUP BY 1),
sh AS (SELECT w.device_id, w.appliance, app_kwh / CASE WHEN total = 0 THEN 1.0 ELSE total END AS share FROM w JOIN t USING (device_id))"""


def _disaggregated(hourly: DataFrame) -> DataFrame:
    """Weights and device totals come from one table of sums per device, appliance and hour, whose shuffle is reused."""
    weights = hourly.groupBy("device_id", "appliance").agg(F.sum("kwh").alias("app_kwh"))
    totals = hourly.groupBy("device_id", "slot_ts").agg(F.sum("kwh").alias("kwh"))
    return disaggregate(totals, weights, ["device_id"])


@query(
    f"""WITH {DEVICE_HOURS_SQL}, {WEIGHTS_SQL}
SELECT hr.device_id, appliance, strftime(slot_ts, {ISO}) AS slot, CAST(kwh AS DOUBLE) * share AS app_actual_kwh
FROM hr JOIN sh USING (device_id)"""
)
def disaggregate_actual(spark: SparkSession, folder: str) -> DataFrame:
    hourly = hourly_energy(readings(spark, folder), ["device_id", "appliance"])
    return _disaggregated(hourly).select(
        "device_id", "appliance", iso(F.col("slot_ts")).alias("slot"), "app_actual_kwh"
    )


@query(
    f"""WITH {DEVICE_HOURS_SQL}, {WEIGHTS_SQL},
ah AS (SELECT device_id, appliance, date_trunc('hour', ts) + INTERVAL 24 HOUR AS slot_ts, SUM(kwh) AS k FROM r GROUP BY 1, 2, 3)
SELECT hr.device_id, appliance, strftime(slot_ts, {ISO}) AS slot, 'prev' AS segment,
  CAST(kwh AS DOUBLE) * share AS actual_kwh, CAST(kwh AS DOUBLE) * share AS forecast_kwh
FROM hr JOIN sh USING (device_id)
UNION ALL
SELECT device_id, appliance, strftime(slot_ts, {ISO}), 'next', NULL, CAST(k AS DOUBLE) * (CAST(1 AS DOUBLE) + CAST(10 AS DOUBLE) / 100)
FROM ah WHERE slot_ts >= TIMESTAMP '{CUTOFF}'"""
)
def appliance_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Per appliance: disaggregated past on both lines, then tomorrow's forecast under 10 % more load."""
    keys = ["device_id", "appliance"]
    # the sums are used three times and are much smaller than the readings, so they are stored
    hourly = stored(hourly_energy(readings(spark, folder), keys), "appliance-hours")
    ahead = naive(hourly, keys).filter(F.col("slot_ts") >= F.lit(CUTOFF).cast("timestamp"))
    scaled = ahead.withColumn("kwh", F.col("kwh").cast("double") * load_factor(F.lit(10)))
    rows = per_appliance(_disaggregated(hourly), scaled, [*keys, "slot_ts"])
    return rows.select(
        *keys, iso(F.col("slot_ts")).alias("slot"), "segment", "actual_kwh", "forecast_kwh"
    )


@query(
    f"""WITH {DEVICE_HOURS_SQL}, p AS (SELECT * FROM (VALUES ('Air Conditioner', CAST(0.55 AS DOUBLE)), ('Refrigerator', CAST(0.25 AS DOUBLE)),
  ('Electric Fan', CAST(0.10 AS DOUBLE)), ('Others', CAST(0.05 AS DOUBLE))) v(part, share))
SELECT device_id, strftime(slot_ts, {ISO}) AS slot, part, ROUND(CAST(kwh AS DOUBLE) * share, 6) AS part_kwh FROM hr CROSS JOIN p"""
)
def fixed_share_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    hourly = hourly_energy(readings(spark, folder), ["device_id"])
    return fixed_parts(hourly).select(
        "device_id", iso(F.col("slot_ts")).alias("slot"), "part", F.round("part_kwh", 6).alias("part_kwh")
    )


@query(
    f"""WITH {DEVICE_HOURS_SQL}, f AS (SELECT * FROM (VALUES ('All Appliances', CAST(1 AS DOUBLE)), ('Refrigerator', CAST(0.25 AS DOUBLE)),
  ('Heater', CAST(0.05 AS DOUBLE))) v(selected, share))
SELECT device_id, selected, ROUND(SUM(CAST(kwh AS DOUBLE) * share), 4) AS selected_kwh FROM hr CROSS JOIN f GROUP BY 1, 2"""
)
def appliance_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Household totals under three filter choices: all, a known appliance and an unknown one."""
    totals = hourly_energy(readings(spark, folder), ["device_id"])
    chosen = appliance_filter(totals, ["All Appliances", "Refrigerator", "Heater"])
    return chosen.groupBy("device_id", "selected").agg(F.round(F.sum("selected_kwh"), 4).alias("selected_kwh"))


@query(
    f"""WITH {HOURS_SQL}
SELECT device_id, strftime(slot_ts, {ISO}) AS slot, CAST(SUM(kwh) AS DOUBLE) AS total_kwh, 5 - COUNT(DISTINCT appliance) AS n_missing,
  strftime(slot_ts, '%B %-d, %Y') AS date_label
FROM hr GROUP BY device_id, slot_ts"""
)
def total_from_appliances(spark: SparkSession, folder: str) -> DataFrame:
    hourly = hourly_energy(readings(spark, folder), ["device_id", "appliance"])
    return slot_totals(hourly, ["device_id"], expected=KINDS).select(
        "device_id", iso(F.col("slot_ts")).alias("slot"), F.col("total_kwh").cast("double").alias("total_kwh"),
        "n_missing", long_date(F.col("slot_ts")).alias("date_label"),
    )


@query(
    f"""WITH {READINGS_SQL}
SELECT appliance, CAST(SUM(kwh) AS DOUBLE) AS kwh,
  CASE appliance WHEN 'view' THEN CAST(1.2 AS DOUBLE) WHEN 'click' THEN CAST(0.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight
FROM r GROUP BY 1"""
)
def appliance_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Totals with a value looked up by appliance name; names outside the dictionary get the default."""
    totals = readings(spark, folder).groupBy("appliance").agg(F.sum("kwh").cast("double").alias("kwh"))
    return totals.withColumn("weight", lookup(F.col("appliance"), {"view": 1.2, "click": 0.8}, 1.0))


@query(
    f"""WITH {HOURS_SQL}, last AS (SELECT MAX(slot_ts) AS m FROM hr)
SELECT device_id, appliance, strftime(slot_ts, {ISO}) AS slot, 'prev' AS segment, CAST(kwh AS DOUBLE) AS kwh FROM hr
UNION ALL
SELECT device_id, appliance, strftime(slot_ts + INTERVAL 24 HOUR, {ISO}), 'next', CAST(kwh AS DOUBLE) FROM hr
WHERE slot_ts + INTERVAL 24 HOUR >= TIMESTAMP '{CUTOFF}'"""
)
def forecast_line(spark: SparkSession, folder: str) -> DataFrame:
    """One line: the past series followed by the coming one."""
    keys = ["device_id", "appliance"]
    hourly = hourly_energy(readings(spark, folder), keys).select(*keys, "slot_ts", F.col("kwh").cast("double").alias("kwh"))
    ahead = naive(hourly, keys).filter(F.col("slot_ts") >= F.lit(CUTOFF).cast("timestamp"))
    return concat_series(hourly, ahead).select(*keys, iso(F.col("slot_ts")).alias("slot"), "segment", "kwh")


@query(
    """WITH g AS (SELECT c_custkey AS device_id, unnest(['view', 'click', 'purchase', 'signup', 'error', 'standby']) AS appliance FROM customer)
SELECT device_id, appliance FROM g
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = g.device_id AND e.event_type = g.appliance)"""
)
def unmatched_appliances(spark: SparkSession, folder: str) -> DataFrame:
    configured = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("device_id"), F.explode(F.array(*[F.lit(a) for a in CONFIGURED])).alias("appliance")
    )
    return configured_without_series(readings(spark, folder), configured, ["device_id"])


@query(
    f"""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat(CAST(value AS VARCHAR), 'kWh') WHEN 1 THEN 'abc'
    WHEN 2 THEN '' WHEN 3 THEN concat('-', CAST({LEVEL_SQL} AS VARCHAR), '.5e1x') ELSE CAST({LEVEL_SQL} AS VARCHAR) END AS txt FROM events)
SELECT event_id, COALESCE(TRY_CAST(nullif(regexp_extract(txt, '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0.0) AS as_double,
  COALESCE(TRY_CAST(nullif(regexp_extract(txt, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS as_int
FROM t"""
)
def input_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    """Typed-in numbers: the leading number counts, anything else is zero."""
    kind, k = F.col("event_id") % 5, level().cast("string")
    text = (
        F.when(kind == 0, F.concat(F.col("value").cast("string"), F.lit("kWh")))
        .when(kind == 1, F.lit("abc"))
        .when(kind == 2, F.lit(""))
        .when(kind == 3, F.concat(F.lit("-"), k, F.lit(".5e1x")))
        .otherwise(k)
    )
    typed = events(spark, folder).select("event_id", text.alias("txt"))
    return typed.select(
        "event_id", leading_double(F.col("txt")).alias("as_double"), leading_int(F.col("txt")).alias("as_int")
    )
