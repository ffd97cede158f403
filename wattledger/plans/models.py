"""Queries on fitted forecasts, their tests, local time, and energy and load across hours."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions.times import iso, local_slot
from wattledger.operators.backtest import errors_by_horizon, rolling_origins
from wattledger.operators.budget import status_badge
from wattledger.operators.forecast import (
    always_on as on_share,
    best_hours as lowest_hours,
    hour_profile as profile_of,
    month_end_forecast as forecast_month,
    seasonal_armax as fit_armax,
    seasonal_arx as fit_arx,
)
from wattledger.operators.normalise import hourly_energy
from wattledger.operators.normalise import interval_energy as between_readings
from wattledger.operators.spans import (
    continuous_runs,
    day_sketches,
    exact_ranks,
    longest_runs as longest_of,
    merged_quantiles,
    prorated_hours,
)
from wattledger.plans.forecasts import DENSE_SQL, appliance_hours
from wattledger.plans.metering import INTERVAL_SQL
from wattledger.plans.registry import query
from wattledger.plans.tables import BUDGETS_SQL, DEVICE_HOURS_SQL, HOURS_SQL, ISO, READINGS_SQL, TARIFF, budgets, counter_readings, readings
from wattledger.session import shared_dir
from wattledger.sources.sinks import write_bucketed_readings

MANILA = "Asia/Manila"  # eight hours ahead of UTC, without summer time


def least_squares_sql(name: str, source: str, regressors: list[str], target: str) -> str:
    """CTEs that end in <name>_beta (appliance, n, b0 ...): the regressors are made orthogonal one after the other, then the
    coefficients follow from the last to the first."""
    m = len(regressors)
    columns = [f"{expression} AS x{k}" for k, expression in enumerate(regressors)]
    whole = " AND ".join(f"({e}) IS NOT NULL" for e in [*regressors, target])
    steps = [f"{name}_0 AS MATERIALIZED (SELECT appliance, {', '.join(columns)}, {target} AS y FROM {source} WHERE {whole})"]
    for k in range(m):
        later = [*(f"x{j}" for j in range(k + 1, m)), "y"]
        ratios = ", ".join(f"SUM(x{k} * {c}) / SUM(x{k} * x{k}) AS r_{c}" for c in later)
        steps.append(f"{name}_r{k} AS MATERIALIZED (SELECT appliance, {ratios} FROM {name}_{k} GROUP BY 1)")
        kept = ", ".join(f"{c} - r_{c} * x{k} AS {c}" for c in later)
        steps.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT appliance, {kept} FROM {name}_{k} JOIN {name}_r{k} USING (appliance))")
    before = f"(SELECT appliance, COUNT(*) AS n FROM {name}_0 GROUP BY 1)"
    for k in reversed(range(m)):
        known = "".join(f" - r.r_x{j} * q.b{j}" for j in range(k + 1, m))
        before = f"(SELECT q.*, r.r_y{known} AS b{k} FROM {before} q JOIN {name}_r{k} r USING (appliance))"
    steps.append(f"{name}_beta AS MATERIALIZED (SELECT * FROM {before})")
    return ",\n".join(steps)


LAGS_SQL = f"""{DENSE_SQL},
d AS (SELECT *, kwh - lag(kwh, 24) OVER (PARTITION BY appliance ORDER BY slot_ts) AS d FROM y),
l AS MATERIALIZED (SELECT *, {', '.join(f'lag(d, {i}) OVER (PARTITION BY appliance ORDER BY slot_ts) AS l{i}' for i in range(1, 5))},
  CASE WHEN dayofweek(slot_ts) IN (0, 6) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS weekend,
  CASE WHEN hour(slot_ts) BETWEEN 18 AND 22 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS evening FROM d)"""
ARX_SQL = least_squares_sql("x", "l", ["CAST(1 AS DOUBLE)", "l1", "l2", "weekend", "evening"], "d")


@query(
    f"""WITH RECURSIVE {LAGS_SQL},
{ARX_SQL},
z AS (SELECT appliance, MAX(slot_ts) AS last, arg_max(d, slot_ts) AS d1, arg_max(l1, slot_ts) AS d2 FROM l GROUP BY 1),
f AS (SELECT appliance, last, 0 AS step, d1, d2 FROM z
  UNION ALL SELECT f.appliance, last, step + 1, b0 + b1 * d1 + b2 * d2 + b3 * CASE WHEN dayofweek(last + to_hours(step + 1)) IN (0, 6) THEN 1 ELSE 0 END
    + b4 * CASE WHEN hour(last + to_hours(step + 1)) BETWEEN 18 AND 22 THEN 1 ELSE 0 END, d1
  FROM f JOIN x_beta USING (appliance) WHERE step < 24)
SELECT f.appliance, n AS n_rows, CAST(step AS INTEGER) AS step, strftime(last + to_hours(step), {ISO}) AS slot, ROUND(y.kwh + d1, 6) AS forecast_kwh,
  ROUND(b0, 6) AS c, ROUND(b1, 6) AS phi1, ROUND(b2, 6) AS phi2, ROUND(b3, 6) AS weekend, ROUND(b4, 6) AS evening
FROM f JOIN x_beta USING (appliance) JOIN y ON y.appliance = f.appliance AND y.slot_ts = last + to_hours(step - 24) WHERE step > 0"""
)
def seasonal_arx(spark: SparkSession, folder: str) -> DataFrame:
    """Two lags plus a weekend flag and the time of day."""
    exog = {
        "weekend": lambda ts: F.dayofweek(ts).isin(1, 7).cast("double"),
        "evening": lambda ts: F.hour(ts).between(18, 22).cast("double"),
    }
    ahead = fit_arx(appliance_hours(spark, folder), ["appliance"], exog, lags=2)
    return ahead.select(
        "appliance", "n_rows", "step", iso(F.col("slot_ts")).alias("slot"), F.round("forecast_kwh", 6).alias("forecast_kwh"),
        *[F.round(F.col("coefficients")[i], 6).alias(n) for i, n in enumerate(["c", "phi1", "phi2", "weekend", "evening"])],
    )


ROUGH_SQL = least_squares_sql("a", "l", ["CAST(1 AS DOUBLE)", "l1", "l2", "l3", "l4"], "d")
SHOCKS_SQL = """e AS (SELECT l.*, d - b0 - b1 * l1 - b2 * l2 - b3 * l3 - b4 * l4 AS e FROM l JOIN a_beta USING (appliance)),
m AS MATERIALIZED (SELECT *, lag(e) OVER (PARTITION BY appliance ORDER BY slot_ts) AS m1 FROM e)"""
MIXED_SQL = least_squares_sql("b", "m", ["CAST(1 AS DOUBLE)", "l1", "m1", "weekend"], "d")


@query(
    f"""WITH RECURSIVE {LAGS_SQL},
{ROUGH_SQL},
{SHOCKS_SQL},
{MIXED_SQL},
z AS (SELECT appliance, MAX(slot_ts) AS last, arg_max(d, slot_ts) AS d, arg_max(e, slot_ts) AS e FROM m GROUP BY 1),
f AS (SELECT appliance, last, 0 AS step, d, e FROM z
  UNION ALL SELECT f.appliance, last, step + 1, b0 + b1 * d + b2 * e + b3 * CASE WHEN dayofweek(last + to_hours(step + 1)) IN (0, 6) THEN 1 ELSE 0 END, CAST(0 AS DOUBLE)
  FROM f JOIN b_beta USING (appliance) WHERE step < 24)
SELECT f.appliance, n AS n_rows, CAST(step AS INTEGER) AS step, strftime(last + to_hours(step), {ISO}) AS slot, ROUND(y.kwh + d, 6) AS forecast_kwh,
  ROUND(b0, 6) AS c, ROUND(b1, 6) AS phi1, ROUND(b2, 6) AS theta1, ROUND(b3, 6) AS weekend
FROM f JOIN b_beta USING (appliance) JOIN y ON y.appliance = f.appliance AND y.slot_ts = last + to_hours(step - 24) WHERE step > 0"""
)
def seasonal_armax(spark: SparkSession, folder: str) -> DataFrame:
    """One lag, one moving-average term and a weekend flag on the seasonal difference, a day ahead."""
    weekend = {"weekend": lambda ts: F.dayofweek(ts).isin(1, 7).cast("double")}
    ahead = fit_armax(appliance_hours(spark, folder), ["appliance"], weekend, ar=1, ma=1, long=4)
    return ahead.select(
        "appliance", "n_rows", F.col("step").cast("int").alias("step"), iso(F.col("slot_ts")).alias("slot"), F.round("forecast_kwh", 6).alias("forecast_kwh"),
        *[F.round(F.col("coefficients")[i], 6).alias(n) for i, n in enumerate(["c", "phi1", "theta1", "weekend"])],
    )


_SUMS = {
    "n": "1.0", "sx": "i", "sy": "kwh", "sxx": "i * i", "sxy": "i * kwh",
    **{f"p{k}": f"CASE WHEN d IS NOT NULL AND d1 IS NOT NULL THEN {v} END" for k, v in {"n": "1.0", "x": "d1", "y": "d", "xx": "d1 * d1", "xy": "d1 * d"}.items()},
}
_RUNNING = ", ".join(f"SUM(CAST({v} AS DOUBLE)) OVER (PARTITION BY appliance ORDER BY slot_ts ROWS UNBOUNDED PRECEDING) AS {k}" for k, v in _SUMS.items())


@query(
    f"""WITH {DENSE_SQL},
r0 AS (SELECT *, CAST(row_number() OVER w - 1 AS DOUBLE) AS i, kwh - lag(kwh, 24) OVER w AS d, lag(kwh, 24) OVER w AS before,
  AVG(kwh) OVER (PARTITION BY appliance, hour(slot_ts) ORDER BY slot_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS profile
  FROM y WINDOW w AS (PARTITION BY appliance ORDER BY slot_ts)),
k AS MATERIALIZED (SELECT *, lag(d) OVER (PARTITION BY appliance ORDER BY slot_ts) AS d1 FROM r0),
f AS (SELECT *, {_RUNNING} FROM k),
o AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, (pn * pxy - px * py) / (pn * pxx - px * px) AS phi FROM f WHERE i >= 71 AND (i - 71) % 24 = 0),
o2 AS (SELECT *, (sy - slope * sx) / n AS base, (py - phi * px) / pn AS c FROM o),
j AS (SELECT o2.appliance, h, k.kwh AS actual, k.before AS naive, k.profile, base + slope * (o2.i + h) AS trend,
  k.before + c * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * o2.d AS ar1
  FROM o2, range(1, 25) t(h), k WHERE k.appliance = o2.appliance AND k.slot_ts = o2.slot_ts + to_hours(h)),
u AS (SELECT appliance, h, actual, unnest(['naive', 'profile', 'trend', 'ar1']) AS model, unnest([naive, profile, trend, ar1]) AS f FROM j)
SELECT appliance, model, CAST(h AS INTEGER) AS horizon, COUNT(f) AS n, ROUND(AVG(abs(actual - f)), 6) AS mae, ROUND(sqrt(AVG((actual - f) * (actual - f))), 6) AS rmse,
  ROUND(AVG(actual - f), 6) + CAST(0 AS DOUBLE) AS bias FROM u GROUP BY 1, 2, 3"""
)
def rolling_origin_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of four models by horizon, 1 to 24 hours after every day's origin."""
    tested = rolling_origins(appliance_hours(spark, folder), ["appliance"])
    out = errors_by_horizon(tested, ["appliance"])
    return out.select("appliance", "model", "horizon", "n", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mae", "rmse", "bias")])


_CUTOFF_SQL = "(TIMESTAMP '2024-01-19 16:00:00' + to_days(CAST(device_id % 5 AS INTEGER)) + to_hours(CAST(device_id % 24 AS INTEGER)))"


@query(
    f"""WITH {DEVICE_HOURS_SQL}, {BUDGETS_SQL},
l AS (SELECT device_id, CAST(kwh AS DOUBLE) AS kwh, slot_ts + INTERVAL 8 HOUR AS l, {_CUTOFF_SQL} + INTERVAL 8 HOUR AS cl FROM hr),
p AS (SELECT *, date_trunc('month', cl) AS ms, hour(l) AS h FROM l WHERE l < cl),
g AS (SELECT device_id, ms, cl, h, SUM(kwh) AS k, SUM(CASE WHEN l >= ms THEN kwh END) AS now, MIN(l) AS first FROM p GROUP BY 1, 2, 3, 4),
k AS (SELECT *, date_trunc('day', MIN(first) OVER (PARTITION BY device_id)) AS begins, ms + INTERVAL 1 MONTH AS me FROM g),
c AS (SELECT *, ceil((epoch(cl) - h * 3600) / 86400.0) AS a, ceil((epoch(begins) - h * 3600) / 86400.0) AS z, ceil((epoch(me) - h * 3600) / 86400.0) AS m FROM k),
t AS (SELECT device_id, strftime(ms, '%Y-%m') AS month, COALESCE(SUM(now), 0) AS kwh_to_date, SUM(k / (a - z) * (m - a)) AS kwh_ahead FROM c GROUP BY 1, 2),
q AS (SELECT *, (kwh_to_date + kwh_ahead) * CAST(13.47 AS DOUBLE) AS cost FROM t)
SELECT q.device_id, month, ROUND(kwh_to_date, 6) AS kwh_to_date, ROUND(kwh_ahead, 6) AS kwh_ahead, ROUND(cost, 6) AS projected_cost,
  CASE WHEN budget = 0 THEN 'neutral' WHEN cost / nullif(budget, 0) >= 1.0 THEN 'danger' WHEN cost / nullif(budget, 0) >= CAST(0.8 AS DOUBLE) THEN 'warning' ELSE 'success' END AS status
FROM q JOIN b ON b.device_id = q.device_id"""
)
def month_end_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The month's cost in local time, each household from its own cutoff on by its profile, against the budget."""
    hourly = hourly_energy(readings(spark, folder), ["device_id"])
    device = F.col("device_id")
    cutoff = F.lit("2024-01-19 16:00:00").cast("timestamp") + F.make_dt_interval(days=(device % 5).cast("int"), hours=(device % 24).cast("int"))
    rows = forecast_month(hourly, ["device_id"], TARIFF, cutoff, MANILA).join(budgets(spark, folder), "device_id")
    return rows.select(
        "device_id", "month", *[F.round(c, 6).alias(c) for c in ("kwh_to_date", "kwh_ahead", "projected_cost")],
        status_badge(F.col("projected_cost"), F.col("budget")).alias("status"),
    )


@query(
    f"""WITH {DEVICE_HOURS_SQL},
p AS (SELECT device_id, CAST(hour(slot_ts + INTERVAL 8 HOUR) AS INTEGER) AS hour, CAST(SUM(kwh) AS DOUBLE) / COUNT(*) AS mean_kwh FROM hr GROUP BY 1, 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY mean_kwh, hour) AS INTEGER) AS rank FROM p)
SELECT device_id, hour, mean_kwh, rank FROM k WHERE rank <= 3"""
)
def best_hours_local(spark: SparkSession, folder: str) -> DataFrame:
    """The three cheapest hours of day on the clock of the household."""
    profile = profile_of(hourly_energy(readings(spark, folder), ["device_id"]), ["device_id"], tz=MANILA)
    return lowest_hours(profile, ["device_id"]).select("device_id", "hour", "mean_kwh", "rank")


@query(
    f"""WITH {HOURS_SQL}
SELECT appliance, strftime(slot_ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, COUNT(*) FILTER (WHERE k > 50) AS active_hours,
  COUNT(*) FILTER (WHERE k > 50) / CAST(24 AS DOUBLE) AS on_share, COUNT(*) FILTER (WHERE k > 50) / CAST(24 AS DOUBLE) >= 0.5 AS is_always_on
FROM (SELECT appliance, slot_ts, SUM(kwh) AS k FROM hr GROUP BY 1, 2) GROUP BY 1, 2"""
)
def always_on_local(spark: SparkSession, folder: str) -> DataFrame:
    """The share of a local day's hours with a load above the floor."""
    rows = readings(spark, folder).withColumn("ts", local_slot(F.col("ts"), MANILA))
    hourly = hourly_energy(rows, ["appliance"])
    return on_share(hourly, ["appliance"], floor=50.0, threshold=0.5, tz=MANILA).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    INTERVAL_SQL
    + f""", g AS (SELECT device_id, epoch_us(ts) - CAST(round(interval_seconds * 1000000) AS BIGINT) AS a, epoch_us(ts) AS z,
  round(CASE WHEN kwh_interval_kwh > 0 THEN kwh_interval_kwh ELSE power_w / CAST(1000 AS DOUBLE) * interval_seconds / CAST(3600 AS DOUBLE) END * 1000000) AS e
  FROM f WHERE interval_seconds IS NOT NULL),
h AS (SELECT *, unnest(generate_series(a // 3600000000, (CASE WHEN z > a THEN z - 1 ELSE z END) // 3600000000)) AS h FROM g),
s AS (SELECT device_id, h, CASE WHEN z = a THEN e ELSE
    (CASE WHEN (h + 1) * 3600000000 >= z THEN round(e * (CAST(z - a AS DOUBLE) / CAST(z - a AS DOUBLE))) ELSE round(e * (CAST((h + 1) * 3600000000 - a AS DOUBLE) / CAST(z - a AS DOUBLE))) END)
    - (CASE WHEN h * 3600000000 <= a THEN 0 ELSE round(e * (CAST(h * 3600000000 - a AS DOUBLE) / CAST(z - a AS DOUBLE))) END) END AS share FROM h)
SELECT device_id, strftime(make_timestamp(h * 3600000000), {ISO}) AS slot, SUM(CAST(share AS BIGINT)) / CAST(1000000 AS DOUBLE) AS kwh, COUNT(*) AS n_parts
FROM s GROUP BY 1, 2"""
)
def hourly_prorated(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly energy where each interval is shared among the hours that it spans."""
    intervals = between_readings(counter_readings(spark, folder), tie=["event_id"], max_gap_seconds=86400)
    hours = prorated_hours(intervals, ["device_id"])
    return hours.select("device_id", iso(F.col("slot_ts")).alias("slot"), "kwh", "n_parts")


@query(
    f"""WITH {HOURS_SQL},
a AS (SELECT appliance, slot_ts FROM hr GROUP BY 1, 2 HAVING SUM(kwh) > 50),
i AS (SELECT *, slot_ts - to_hours(CAST(row_number() OVER (PARTITION BY appliance ORDER BY slot_ts) AS INTEGER)) AS island FROM a),
u AS (SELECT appliance, MIN(slot_ts) AS first_ts, MAX(slot_ts) AS last_ts, COUNT(*) AS n FROM i GROUP BY appliance, island),
k AS (SELECT *, COUNT(*) OVER (PARTITION BY appliance) AS n_runs, row_number() OVER (PARTITION BY appliance ORDER BY n DESC, first_ts) AS rn FROM u)
SELECT appliance, n_runs, CAST(n AS DOUBLE) AS run_hours, strftime(first_ts, {ISO}) AS first_hour, strftime(last_ts, {ISO}) AS last_hour FROM k WHERE rn = 1"""
)
def longest_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The longest stretch of hours without a break in which an appliance drew more than 50 kWh each."""
    hourly = hourly_energy(readings(spark, folder), ["appliance"])
    runs = continuous_runs(hourly, ["appliance"], F.col("kwh") > 50)
    best = longest_of(runs, ["appliance"])
    return best.select("appliance", "n_runs", "run_hours", iso(F.col("first_ts")).alias("first_hour"), iso(F.col("last_ts")).alias("last_hour"))


@query(f"WITH {READINGS_SQL} SELECT device_id, COUNT(*) AS n, true AS within_bound FROM r GROUP BY 1")
def sketched_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the 90 % quantile of each device from its merged day sketches has a rank within 2 % of 90 %."""
    rows = readings(spark, folder)
    found = merged_quantiles(day_sketches(rows, "device_id", "kwh"), ["device_id"], [0.9])
    ranks = exact_ranks(rows, "device_id", "kwh", found, "q90")
    within = (F.col("upto") >= 0.88) & (F.col("below") <= 0.92)
    return found.join(ranks, "device_id").select("device_id", "n", within.alias("within_bound"))


@query(
    f"""WITH {DEVICE_HOURS_SQL}
SELECT device_id, strftime(slot_ts, {ISO}) AS slot, CAST(kwh AS DOUBLE) AS kwh FROM hr"""
)
def hourly_from_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly energy from readings in buckets of devices: the sums need no shuffle."""
    name = f"readings_{uuid.uuid4().hex}"
    write_bucketed_readings(readings(spark, folder), name, 32, path=shared_dir(spark, "bucketed"))
    hourly = hourly_energy(spark.table(name), ["device_id"])
    return hourly.select("device_id", iso(F.col("slot_ts")).alias("slot"), F.col("kwh").cast("double").alias("kwh"))
