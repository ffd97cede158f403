"""Queries on forecasts and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions.times import iso
from wattledger.operators.budget import status_badge
from wattledger.operators.cost import period_totals
from wattledger.operators.forecast import (
    always_on as on_share,
    best_hours as lowest_hours,
    deviation_flags as flag_deviations,
    forecast_error as errors_of,
    hour_profile as profile_of,
    linear_trend as trend_of,
    month_end_projection as project_month,
    profile_forecast as forecast_by_profile,
    range_check as check_range,
    risk_drivers as drivers_of,
    seasonal_ar1 as fit_ar1,
    seasonal_naive as naive,
    with_residuals,
)
from wattledger.operators.normalise import dense_hours, hourly_energy
from wattledger.plans.costs import day_text
from wattledger.plans.registry import query
from wattledger.plans.tables import (
    APPLIANCE_HOURS_SQL,
    BUDGETS_SQL,
    DEVICE_HOURS_SQL,
    HOURS_SQL,
    ISO,
    READINGS_SQL,
    TARIFF,
    budgets,
    readings,
)


def appliance_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Dense hourly energy per appliance over all devices; hours without a reading have zero."""
    hourly = hourly_energy(readings(spark, folder), ["appliance"]).select(
        "appliance", "slot_ts", F.col("kwh").cast("double").alias("kwh")
    )
    return dense_hours(hourly, ["appliance"]).withColumn("kwh", F.coalesce("kwh", F.lit(0.0)))


DENSE_SQL = f"""{APPLIANCE_HOURS_SQL},
g AS (SELECT appliance, unnest(generate_series(min(slot_ts), max(slot_ts), INTERVAL 1 HOUR)) AS slot_ts FROM hr GROUP BY 1),
y AS (SELECT g.appliance, g.slot_ts, COALESCE(CAST(hr.kwh AS DOUBLE), 0.0) AS kwh FROM g
  LEFT JOIN hr ON hr.appliance = g.appliance AND hr.slot_ts = g.slot_ts)"""


@query(
    f"""WITH {DENSE_SQL}
SELECT appliance, strftime(slot_ts + INTERVAL 24 HOUR, {ISO}) AS slot, kwh AS forecast_kwh FROM y
UNION ALL
SELECT appliance, strftime(slot_ts + INTERVAL 48 HOUR, {ISO}), kwh FROM (SELECT *, MAX(slot_ts) OVER (PARTITION BY appliance) AS m FROM y)
WHERE slot_ts > m - INTERVAL 24 HOUR AND slot_ts + INTERVAL 48 HOUR <= m + INTERVAL 36 HOUR"""
)
def seasonal_naive(spark: SparkSession, folder: str) -> DataFrame:
    """Yesterday's value as forecast, up to 36 hours past the end."""
    ahead = naive(appliance_hours(spark, folder), ["appliance"], horizon=36)
    return ahead.select("appliance", iso(F.col("slot_ts")).alias("slot"), F.col("kwh").alias("forecast_kwh"))


@query(
    f"""WITH {DEVICE_HOURS_SQL}
SELECT device_id, CAST(hour(slot_ts) AS INTEGER) AS hour, CAST(dayofweek(slot_ts) + 1 AS INTEGER) AS weekday,
  CAST(SUM(kwh) AS DOUBLE) / COUNT(*) AS mean_kwh, COUNT(*) AS n_hours
FROM hr GROUP BY 1, 2, 3"""
)
def hour_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile_of(hourly_energy(readings(spark, folder), ["device_id"]), ["device_id"], by_weekday=True)


@query(
    f"""WITH {DEVICE_HOURS_SQL},
p AS (SELECT device_id, hour(slot_ts) AS h, CAST(SUM(kwh) AS DOUBLE) / COUNT(*) AS m FROM hr GROUP BY 1, 2),
f AS (SELECT device_id, unnest(generate_series(MAX(slot_ts) + INTERVAL 1 HOUR, MAX(slot_ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS slot_ts FROM hr GROUP BY 1)
SELECT f.device_id, strftime(f.slot_ts, {ISO}) AS slot, p.m AS forecast_kwh
FROM f LEFT JOIN p ON p.device_id = f.device_id AND p.h = hour(f.slot_ts)"""
)
def profile_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The hour-of-day means laid over the day after a device's last reading."""
    hourly = hourly_energy(readings(spark, folder), ["device_id"])
    return forecast_by_profile(hourly, ["device_id"], 24).select("device_id", iso(F.col("slot_ts")).alias("slot"), "forecast_kwh")


@query(
    f"""WITH {DENSE_SQL},
i AS (SELECT *, (epoch(slot_ts) - MIN(epoch(slot_ts)) OVER (PARTITION BY appliance)) / 3600 AS x FROM y),
f AS (SELECT appliance, regr_slope(kwh, x) AS increment, regr_intercept(kwh, x) AS base, MAX(x) AS mx, MAX(slot_ts) AS m FROM i GROUP BY 1),
s AS (SELECT *, unnest(range(1, 25)) AS step FROM f)
SELECT appliance, CAST(step AS INTEGER) AS step, strftime(m + to_hours(step), {ISO}) AS slot, ROUND(base, 6) AS base, ROUND(increment, 6) AS increment,
  ROUND(base + (mx + step) * increment, 6) AS forecast_kwh FROM s"""
)
def linear_trend(spark: SparkSession, folder: str) -> DataFrame:
    ahead = trend_of(appliance_hours(spark, folder), ["appliance"], 24)
    return ahead.select(
        "appliance", "step", iso(F.col("slot_ts")).alias("slot"), F.round("base", 6).alias("base"),
        F.round("increment", 6).alias("increment"), F.round("forecast_kwh", 6).alias("forecast_kwh"),
    )


@query(
    f"""WITH {DENSE_SQL},
d AS (SELECT *, kwh - lag(kwh, 24) OVER (PARTITION BY appliance ORDER BY slot_ts) AS d FROM y),
e AS (SELECT *, lag(d) OVER (PARTITION BY appliance ORDER BY slot_ts) AS d1 FROM d),
f AS (SELECT appliance, regr_slope(d, d1) AS phi, regr_intercept(d, d1) AS c, arg_max(d, slot_ts) AS dl, MAX(slot_ts) AS m FROM e GROUP BY 1),
s AS (SELECT *, unnest(range(1, 25)) AS step FROM f)
SELECT s.appliance, CAST(step AS INTEGER) AS step, strftime(m + to_hours(step), {ISO}) AS slot, ROUND(phi, 6) AS phi, ROUND(c, 6) AS c,
  ROUND(y.kwh + c * (1 - pow(phi, step)) / (1 - phi) + pow(phi, step) * dl, 6) AS forecast_kwh
FROM s JOIN y ON y.appliance = s.appliance AND y.slot_ts = m + to_hours(step - 24)"""
)
def seasonal_ar1(spark: SparkSession, folder: str) -> DataFrame:
    ahead = fit_ar1(appliance_hours(spark, folder), ["appliance"])
    return ahead.select(
        "appliance", "step", iso(F.col("slot_ts")).alias("slot"), F.round("phi", 6).alias("phi"), F.round("c", 6).alias("c"),
        F.round("forecast_kwh", 6).alias("forecast_kwh"),
    )


RESIDUALS_SQL = f"""{DENSE_SQL},
rs AS (SELECT a.appliance, a.slot_ts, a.kwh AS actual_kwh, f.kwh AS forecast_kwh, a.kwh - f.kwh AS residual
  FROM y a JOIN y f ON f.appliance = a.appliance AND a.slot_ts = f.slot_ts + INTERVAL 24 HOUR)"""


def _residuals(spark: SparkSession, folder: str) -> DataFrame:
    series = appliance_hours(spark, folder)
    return with_residuals(series, naive(series, ["appliance"]), ["appliance"])


@query(
    f"""WITH {RESIDUALS_SQL},
s AS (SELECT *, stddev_samp(residual) OVER (PARTITION BY appliance, hour(slot_ts)) AS sd FROM rs)
SELECT appliance, strftime(slot_ts, {ISO}) AS slot, ROUND(residual, 6) AS residual, ROUND(sd, 6) AS residual_sd,
  COALESCE(abs(residual) > 2.0 * sd, false) AS is_deviation FROM s"""
)
def deviation_flags(spark: SparkSession, folder: str) -> DataFrame:
    return flag_deviations(_residuals(spark, folder), ["appliance"]).select(
        "appliance", iso(F.col("slot_ts")).alias("slot"), F.round("residual", 6).alias("residual"),
        F.round("residual_sd", 6).alias("residual_sd"), "is_deviation",
    )


@query(
    f"""WITH {RESIDUALS_SQL}
SELECT appliance, COUNT(*) AS n, ROUND(AVG(abs(residual)), 6) AS mae, ROUND(sqrt(AVG(residual * residual)), 6) AS rmse, ROUND(AVG(residual), 6) AS bias
FROM rs GROUP BY 1"""
)
def forecast_error(spark: SparkSession, folder: str) -> DataFrame:
    out = errors_of(_residuals(spark, folder), ["appliance"])
    return out.select("appliance", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias")])


@query(
    f"""WITH {HOURS_SQL}
SELECT device_id, appliance, strftime(slot_ts, {ISO}) AS slot, CAST(kwh AS DOUBLE) AS kwh,
  CASE appliance WHEN 'view' THEN CAST(kwh AS DOUBLE) BETWEEN CAST(2.2 AS DOUBLE) AND CAST(28 AS DOUBLE)
    WHEN 'click' THEN CAST(kwh AS DOUBLE) BETWEEN CAST(1.1 AS DOUBLE) AND CAST(14 AS DOUBLE) END AS in_range
FROM hr"""
)
def range_check(spark: SparkSession, folder: str) -> DataFrame:
    hourly = hourly_energy(readings(spark, folder), ["device_id", "appliance"])
    return check_range(hourly, {"view": (2.2, 28.0), "click": (1.1, 14.0)}).select(
        "device_id", "appliance", iso(F.col("slot_ts")).alias("slot"), F.col("kwh").cast("double").alias("kwh"), "in_range"
    )


@query(
    f"""WITH {READINGS_SQL},
s AS (SELECT device_id, appliance, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS p, SUM(kwh) AS k FROM r GROUP BY 1, 2, 3),
u AS (SELECT device_id, appliance, p, k AS d FROM s UNION ALL SELECT device_id, appliance, p + 1, -k FROM s),
a AS (SELECT device_id, appliance, p, SUM(d) AS delta FROM u GROUP BY 1, 2, 3),
t AS (SELECT *, SUM(delta) OVER (PARTITION BY device_id, p) AS total FROM a)
SELECT device_id, strftime(make_timestamp(p * 86400000000), '%Y-%m-%d') AS base_day, appliance, CAST(delta AS DOUBLE) AS delta_kwh, CAST(total AS DOUBLE) AS total_delta_kwh,
  ROUND(CASE WHEN total = 0 THEN 0.0 ELSE CAST(delta AS DOUBLE) / CAST(total AS DOUBLE) END, 6) AS driver_share,
  CAST(row_number() OVER (PARTITION BY device_id, p ORDER BY delta DESC, appliance) AS INTEGER) AS driver_rank
FROM t"""
)
def risk_drivers(spark: SparkSession, folder: str) -> DataFrame:
    paired = period_totals(readings(spark, folder), ["device_id", "appliance"], 24)
    return drivers_of(paired, ["device_id", "period"]).select(
        "device_id", day_text(F.col("period")).alias("base_day"), "appliance", "delta_kwh", "total_delta_kwh",
        F.round("driver_share", 6).alias("driver_share"), "driver_rank",
    )


@query(
    f"""WITH {READINGS_SQL}, {BUDGETS_SQL},
k AS (SELECT device_id, strftime(ts, '%Y-%m') AS month, CAST(SUM(CASE WHEN day(ts) <= 20 THEN kwh ELSE 0 END) AS DOUBLE) AS kwh_to_date,
    day(last_day(MIN(CAST(ts AS DATE)))) AS n FROM r GROUP BY 1, 2),
p AS (SELECT *, kwh_to_date * CAST(13.47 AS DOUBLE) AS c FROM k),
q AS (SELECT *, c + c / CAST(20 AS DOUBLE) * (n - 20) AS proj FROM p)
SELECT q.device_id, month, kwh_to_date, c AS cost_to_date, proj AS projected_cost,
  CASE WHEN budget = 0 THEN 'neutral' WHEN proj / nullif(budget, 0) >= 1.0 THEN 'danger' WHEN proj / nullif(budget, 0) >= CAST(0.8 AS DOUBLE) THEN 'warning' ELSE 'success' END AS status
FROM q JOIN b ON b.device_id = q.device_id"""
)
def month_end_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Days 1-20 as actual values, the rest of the month projected, against the monthly budget."""
    projected = project_month(hourly_energy(readings(spark, folder), ["device_id"]), ["device_id"], TARIFF)
    rows = projected.join(budgets(spark, folder), "device_id")
    return rows.select(
        "device_id", "month", "kwh_to_date", "cost_to_date", "projected_cost",
        status_badge(F.col("projected_cost"), F.col("budget")).alias("status"),
    )


@query(
    f"""WITH {DEVICE_HOURS_SQL},
p AS (SELECT device_id, CAST(hour(slot_ts) AS INTEGER) AS hour, CAST(SUM(kwh) AS DOUBLE) / COUNT(*) AS mean_kwh FROM hr GROUP BY 1, 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY mean_kwh, hour) AS INTEGER) AS rank FROM p)
SELECT device_id, hour, mean_kwh, rank FROM k WHERE rank <= 3"""
)
def best_hours(spark: SparkSession, folder: str) -> DataFrame:
    profile = profile_of(hourly_energy(readings(spark, folder), ["device_id"]), ["device_id"])
    return lowest_hours(profile, ["device_id"]).select("device_id", "hour", "mean_kwh", "rank")


@query(
    f"""WITH {HOURS_SQL}
SELECT appliance, strftime(slot_ts, '%Y-%m-%d') AS day, COUNT(*) FILTER (WHERE k > 50) AS active_hours,
  COUNT(*) FILTER (WHERE k > 50) / CAST(24 AS DOUBLE) AS on_share, COUNT(*) FILTER (WHERE k > 50) / CAST(24 AS DOUBLE) >= 0.5 AS is_always_on
FROM (SELECT appliance, slot_ts, SUM(kwh) AS k FROM hr GROUP BY 1, 2) GROUP BY 1, 2"""
)
def always_on(spark: SparkSession, folder: str) -> DataFrame:
    hourly = hourly_energy(readings(spark, folder), ["appliance"])
    return on_share(hourly, ["appliance"], floor=50.0, threshold=0.5).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
