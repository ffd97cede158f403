"""Forecasts and diagnostics on hourly series.

No model is shipped with the product these operators serve; its texts only name one. The meaning of
each operator is therefore defined here, in its docstring. A key has at most one row per hour in an
hourly series, so windows over a key grow with the length of the history, not with the readings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.functions.times import HOUR_US, add_hours, local, local_date, local_hour
from wattledger.operators.series import lookup, overlay, shift_slots


def seasonal_naive(
    series: DataFrame, keys: list[str], season: int = 24, horizon: int | None = None,
    slot: str = "slot_ts", value: str = "kwh",
) -> DataFrame:
    """The value one season earlier, for all slots up to ``horizon`` hours past the last one.

    Slots further than a season away repeat the last season.
    """
    if horizon is None or horizon == season:
        return shift_slots(series.select(*keys, slot, value), season, slot)
    last = F.max(slot).over(Window.partitionBy(*keys))
    seasons = F.sequence(F.lit(1), F.lit(max(1, -(-horizon // season))))
    return (
        series.select(*keys, slot, value)
        .withColumn("_last", last)
        .withColumn("_m", F.explode(seasons))
        .withColumn(slot, add_hours(F.col(slot), F.col("_m") * season))
        .filter(F.col(slot) <= add_hours(F.col("_last"), horizon))
        # Later seasons repeat the last one only: drop copies of older values.
        .filter((F.col("_m") == 1) | (F.col(slot) > add_hours(F.col("_last"), (F.col("_m") - 1) * season)))
        .drop("_last", "_m")
    )


def hour_profile(
    series: DataFrame, keys: list[str], by_weekday: bool = False, slot: str = "slot_ts", value: str = "kwh",
    tz: str | Column | None = None,
) -> DataFrame:
    """Mean per hour of day (and weekday, 1 = Sunday) over the hours that have a row; hours on the clock of ``tz``."""
    parts = [local_hour(F.col(slot), tz).alias("hour")]
    if by_weekday:
        parts.append(F.dayofweek(local_date(F.col(slot), tz)).alias("weekday"))
    return series.groupBy(*keys, *parts).agg(
        (F.sum(value).cast("double") / F.count(value)).alias("mean_kwh"), F.count(value).alias("n_hours")
    )


def profile_forecast(
    series: DataFrame, keys: list[str], horizon: int, slot: str = "slot_ts", value: str = "kwh", tz: str | None = None
) -> DataFrame:
    """The profile laid over the ``horizon`` hours after a key's last slot."""
    future = (
        series.groupBy(*keys)
        .agg(F.max(slot).alias("_last"))
        .withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn(slot, add_hours(F.col("_last"), F.col("_j")))
        .withColumn("hour", local_hour(F.col(slot), tz))
    )
    profile = hour_profile(series, keys, slot=slot, value=value, tz=tz)
    return future.join(profile, [*keys, "hour"], "left").select(
        *keys, slot, F.col("mean_kwh").alias("forecast_kwh")
    )


def linear_trend(
    series: DataFrame, keys: list[str], horizon: int, slot: str = "slot_ts", value: str = "kwh"
) -> DataFrame:
    """Straight line base + i * increment through a key's series (i counts hours from its first
    slot), continued for ``horizon`` hours. One aggregate; no window."""
    index = F.floor(F.unix_seconds(slot) / F.lit(3600)).cast("double")
    y = F.col(value).cast("double")
    fit = series.groupBy(*keys).agg(
        F.regr_slope(y, index).alias("increment"),
        F.avg(F.when(F.col(value).isNotNull(), index)).alias("_mean_x"),
        F.avg(y).alias("_mean_y"),
        F.min(index).alias("_first"),
        F.max(slot).alias("_last"),
        F.max(index).alias("_last_x"),
    )
    return (
        fit.withColumn("base", F.col("_mean_y") - F.col("increment") * (F.col("_mean_x") - F.col("_first")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(
            *keys,
            "step",
            add_hours(F.col("_last"), F.col("step")).alias(slot),
            "base",
            "increment",
            (F.col("base") + (F.col("_last_x") - F.col("_first") + F.col("step")) * F.col("increment")).alias(
                "forecast_kwh"
            ),
        )
    )


def _lagged(column: str, hours: int, keys: list[str], slot: str) -> Column:
    """The key's value ``hours`` hours earlier; null where the series has a hole there."""
    index = F.floor(F.unix_micros(slot) / F.lit(HOUR_US)).cast("bigint")
    return F.first(column).over(Window.partitionBy(*keys).orderBy(index).rangeBetween(-hours, -hours))


def _seasonal_difference(
    series: DataFrame, keys: list[str], season: int, slot: str, value: str
) -> DataFrame:
    """The difference to the value a season earlier; null where the series has a hole there."""
    y = F.col(value).cast("double")
    rows = series.select(*keys, slot, y.alias("_y"))
    return rows.withColumn("_d", F.col("_y") - _lagged("_y", season, keys, slot))


def _add_season_back(
    steps: DataFrame, series: DataFrame, keys: list[str], season: int, slot: str, value: str
) -> DataFrame:
    """Turn predicted differences at ``slot`` into values by adding the value a season earlier."""
    base = shift_slots(series.select(*keys, slot, F.col(value).cast("double").alias("_base")), season, slot)
    return steps.join(base, [*keys, slot], "left").withColumn("forecast_kwh", F.col("_base") + F.col("d_hat")).drop("_base")


def seasonal_ar1(
    series: DataFrame, keys: list[str], horizon: int = 24, season: int = 24,
    slot: str = "slot_ts", value: str = "kwh",
) -> DataFrame:
    """First-order autoregression of the seasonal difference; a pair with a hole in it takes no part in the fit.

    d(t) = y(t) - y(t - season) and d(t) = c + phi * d(t - 1), fitted by least squares. Step h uses the
    closed form c * (1 - phi^h) / (1 - phi) + phi^h * d(T); ``horizon`` is at most one season.
    """
    if horizon > season:
        raise ValueError("horizon must not exceed the season")
    fit = (
        _seasonal_difference(series, keys, season, slot, value)
        .withColumn("_d1", _lagged("_d", 1, keys, slot))
        .groupBy(*keys)
        .agg(
            F.regr_slope("_d", "_d1").alias("phi"),
            F.regr_intercept("_d", "_d1").alias("c"),
            F.max_by("_d", slot).alias("_d_last"),
            F.max(slot).alias("_last"),
        )
    )
    power = F.pow(F.col("phi"), F.col("step").cast("double"))
    drift = F.when(F.col("phi") == 1.0, F.col("c") * F.col("step")).otherwise(
        F.col("c") * (F.lit(1.0) - power) / (F.lit(1.0) - F.col("phi"))
    )
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *keys,
        "step",
        "phi",
        "c",
        add_hours(F.col("_last"), F.col("step")).alias(slot),
        (drift + power * F.col("_d_last")).alias("d_hat"),
    )
    return _add_season_back(steps, series, keys, season, slot, value)


def seasonal_arx(
    series: DataFrame, keys: list[str], exog: dict[str, Callable[[Column], Column]], lags: int = 2,
    horizon: int = 24, season: int = 24, slot: str = "slot_ts", value: str = "kwh",
) -> DataFrame:
    """Autoregression of the seasonal difference with ``lags`` lags and external regressors; rows with a hole among
    their lags take no part in the fit.

    ``exog`` maps a name to a function of the slot time, so that future values are known. Spark sums
    the products of all regressors per key (partial sums before the shuffle); Python only solves one
    small system per key and rolls the forecast forward. A singular system takes the least-norm
    solution. Keys too short to fit keep their steps, with null forecasts.
    """
    if horizon > season:
        raise ValueError("horizon must not exceed the season")
    data = _seasonal_difference(series, keys, season, slot, value)
    for i in range(1, lags + 1):
        data = data.withColumn(f"_l{i}", _lagged("_d", i, keys, slot))
    for name, feature in exog.items():
        data = data.withColumn(f"_x_{name}", feature(F.col(slot)).cast("double"))
    regressors = ["_one", *[f"_l{i}" for i in range(1, lags + 1)], *[f"_x_{n}" for n in exog]]
    data = data.withColumn("_one", F.lit(1.0))
    complete = F.lit(True)
    for name in [*regressors, "_d"]:
        complete = complete & F.col(name).isNotNull()
    product = lambda a, b: F.sum(F.when(complete, F.col(a) * F.col(b)))
    newest = [F.col("_d"), *[F.col(f"_l{i}") for i in range(1, lags)]]
    fit = data.groupBy(*keys).agg(
        F.array(*[product(a, b) for a in regressors for b in regressors]).alias("_gram"),
        F.array(*[product(a, "_d") for a in regressors]).alias("_moment"),
        F.sum(complete.cast("int")).alias("n_rows"),
        F.max_by(F.array(*newest), slot).alias("_newest"),
        F.max(slot).alias("_last"),
    )
    ahead = F.sequence(F.lit(1), F.lit(horizon))
    future = F.transform(
        ahead,
        lambda j: F.array(*[f(F.col("_last") + F.make_dt_interval(hours=j)).cast("double") for f in exog.values()]),
    )
    fit = fit.withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).withColumn("_future", F.flatten(future) if exog else F.array().cast("array<double>"))
    schema = T.StructType(
        [
            *[series.schema[k] for k in keys],
            T.StructField("_last", T.TimestampType()),
            T.StructField("n_rows", T.LongType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
            T.StructField("steps", T.ArrayType(T.DoubleType())),
        ]
    )
    size, n_exog = len(regressors), len(exog)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coefficients, steps = [], []
            for n, gram, moment, newest, ahead_x in zip(pdf["n_rows"], pdf["_gram"], pdf["_moment"], pdf["_newest"], pdf["_future"]):
                if not n:  # too short to fit: the key stays, without a forecast
                    coefficients.append(None)
                    steps.append([None] * horizon)
                    continue
                beta = np.linalg.lstsq(np.asarray(gram, float).reshape(size, size), np.asarray(moment, float), rcond=None)[0]
                known, x, out = list(newest), np.asarray(ahead_x, float).reshape(horizon, n_exog), []
                for j in range(horizon):
                    d = float(beta[0] + beta[1 : lags + 1] @ known[:lags] + beta[lags + 1 :] @ x[j])
                    known.insert(0, d)
                    out.append(d)
                coefficients.append(beta.tolist())
                steps.append(out)
            yield pdf[[*keys, "_last", "n_rows"]].assign(coefficients=coefficients, steps=steps)

    steps = (
        fit.select(*keys, "_last", "n_rows", "_gram", "_moment", "_newest", "_future")
        .mapInPandas(solve, schema)
        .select(*keys, "_last", "n_rows", "coefficients", F.posexplode("steps").alias("_i", "d_hat"))
        .select(
            *keys, "n_rows", "coefficients", (F.col("_i") + 1).alias("step"),
            add_hours(F.col("_last"), F.col("_i") + 1).alias(slot), "d_hat",
        )
    )
    return _add_season_back(steps, series, keys, season, slot, value)


def seasonal_armax(
    series: DataFrame, keys: list[str], exog: dict[str, Callable[[Column], Column]] | None = None, ar: int = 1, ma: int = 1,
    long: int = 8, horizon: int = 24, season: int = 24, slot: str = "slot_ts", value: str = "kwh",
) -> DataFrame:
    """Seasonal autoregression with moving-average terms, in two regressions of the seasonal difference d.

    First d is regressed on a constant and ``long`` lags of itself; what is left are estimates of the shocks e. Then
    d(t) = c + sum phi_i d(t - i) + sum theta_j e(t - j) + sum b_k x_k(t) + e(t). Rows with a hole among their lags take no
    part. Shocks after the end are zero. Spark sums the products of the regressors per key; Python solves two small
    systems per key (the least-norm solution of a singular one).

    Per key and step: n_rows, coefficients (c, phi, theta, exog), std_errors (from the residual variance and the inverse
    of the products; null without a degree of freedom), sigma, d_hat and forecast_kwh. Keys too short to fit keep their
    steps, with null forecasts.
    """
    if horizon > season:
        raise ValueError("horizon must not exceed the season")
    exog = exog or {}
    data = _seasonal_difference(series, keys, season, slot, value).withColumn("_one", F.lit(1.0))
    for i in range(1, max(long, ar) + 1):
        data = data.withColumn(f"_l{i}", _lagged("_d", i, keys, slot))
    for name, feature in exog.items():
        data = data.withColumn(f"_x_{name}", feature(F.col(slot)).cast("double"))
    first = ["_one", *[f"_l{i}" for i in range(1, long + 1)]]
    rough = _least_squares(data, keys, first, "_d").select(*keys, F.col("beta").alias("_rough"))
    fitted = F.lit(0.0)
    for i, name in enumerate(first):
        fitted = fitted + F.col("_rough")[i] * F.col(name)
    data = data.join(rough, keys, "left").withColumn("_e", F.col("_d") - fitted).drop("_rough")
    for j in range(1, ma + 1):
        data = data.withColumn(f"_m{j}", _lagged("_e", j, keys, slot))
    second = ["_one", *[f"_l{i}" for i in range(1, ar + 1)], *[f"_m{j}" for j in range(1, ma + 1)], *[f"_x_{n}" for n in exog]]
    newest = F.array(F.col("_d"), *[F.col(f"_l{i}") for i in range(1, ar)], F.col("_e"), *[F.col(f"_m{j}") for j in range(1, ma)])
    last = data.groupBy(*keys).agg(F.max(slot).alias("_last"), F.max_by(newest, slot).alias("_newest"))
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda h: F.array(*[f(F.col("_last") + F.make_dt_interval(hours=h)).cast("double") for f in exog.values()]),
    )
    fit = last.join(_least_squares(data, keys, second, "_d"), keys, "left")
    fit = fit.withColumn("_future", F.flatten(ahead) if exog else F.array().cast("array<double>"))
    schema = T.StructType([*fit.drop("_newest", "_future").schema.fields, T.StructField("steps", T.ArrayType(T.DoubleType()))])
    kept, n_exog = schema.names[:-1], len(exog)

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            steps = []
            for beta, newest, future in zip(pdf["beta"], pdf["_newest"], pdf["_future"]):
                known = np.asarray([np.nan if v is None else v for v in newest], float)
                if beta is None or np.isnan(known).any():
                    steps.append([None] * horizon)
                    continue
                beta, x, out = np.asarray(beta, float), np.asarray(future, float).reshape(horizon, n_exog), []
                d, e = known[:ar].tolist() if ar else [], known[max(ar, 1) :][:ma].tolist()
                for h in range(horizon):
                    step = beta[0] + beta[1 : ar + 1] @ d[:ar] + beta[ar + 1 : ar + ma + 1] @ e[:ma] + beta[ar + ma + 1 :] @ x[h]
                    d, e = [step, *d], [0.0, *e]
                    out.append(float(step))
                steps.append(out)
            yield pdf[kept].assign(steps=steps)

    steps = fit.select(*kept, "_newest", "_future").mapInPandas(roll, schema)
    steps = steps.select(*kept, F.posexplode("steps").alias("_i", "d_hat")).select(
        *keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("beta").alias("coefficients"), "std_errors", "sigma",
        (F.col("_i") + 1).alias("step"), add_hours(F.col("_last"), F.col("_i") + 1).alias(slot), "d_hat",
    )
    return _add_season_back(steps, series, keys, season, slot, value)


def _least_squares(data: DataFrame, keys: list[str], regressors: list[str], target: str) -> DataFrame:
    """keys, n_rows, beta, std_errors and sigma of the rows without nulls, from sums of products per key."""
    complete = F.lit(True)
    for name in [*regressors, target]:
        complete = complete & F.col(name).isNotNull()
    names = [*regressors, target]
    size = len(regressors)
    sums = data.where(complete).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]).alias("_products")
    )
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *[data.schema[k] for k in keys], T.StructField("n_rows", T.LongType()), T.StructField("beta", numbers),
        T.StructField("std_errors", numbers), T.StructField("sigma", T.DoubleType()),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(size + 1)
        for pdf in batches:
            betas, errors, sigmas = [], [], []
            for n, products in zip(pdf["n_rows"], pdf["_products"]):
                whole = np.zeros((size + 1, size + 1))
                whole[upper] = np.asarray(products, float)
                whole += np.triu(whole, 1).T
                gram, moment = whole[:size, :size], whole[:size, size]
                beta = np.linalg.lstsq(gram, moment, rcond=None)[0]
                free = n - size
                variance = max(whole[size, size] - beta @ moment, 0.0) / free if free > 0 else np.nan
                betas.append(beta.tolist())
                errors.append(np.sqrt(np.maximum(variance * np.diag(np.linalg.pinv(gram)), 0.0)).tolist() if free > 0 else None)
                sigmas.append(np.sqrt(variance) if free > 0 else None)
            yield pdf[[*keys, "n_rows"]].assign(beta=betas, std_errors=errors, sigma=pd.array(sigmas, dtype="Float64"))

    return sums.mapInPandas(solve, schema)


def with_residuals(
    actual: DataFrame, forecast: DataFrame, keys: list[str], slot: str = "slot_ts", value: str = "kwh"
) -> DataFrame:
    """Slots that have both an actual and a forecast value."""
    both = overlay(actual, forecast, keys, slot, value)
    return both.filter(F.col("actual_kwh").isNotNull() & F.col("forecast_kwh").isNotNull()).withColumn(
        "residual", F.col("actual_kwh") - F.col("forecast_kwh")
    )


def deviation_flags(
    residuals: DataFrame, keys: list[str], k: float = 2.0, slot: str = "slot_ts", tz: str | Column | None = None
) -> DataFrame:
    """Slots whose residual exceeds ``k`` sample deviations of the key's residuals at that hour of the clock of ``tz``."""
    same_hour = Window.partitionBy(*keys, "hour")
    return (
        residuals.withColumn("hour", local_hour(F.col(slot), tz))
        .withColumn("residual_sd", F.stddev_samp("residual").over(same_hour))
        .withColumn(
            "is_deviation",
            F.coalesce(F.abs("residual") > F.lit(float(k)) * F.col("residual_sd"), F.lit(False)),
        )
    )


def range_check(
    df: DataFrame, ranges: dict[str, tuple[float, float]], appliance: str = "appliance", value: str = "kwh"
) -> DataFrame:
    """Whether the value lies within the appliance's range; null without a range."""
    low = lookup(F.col(appliance), {k: v[0] for k, v in ranges.items()})
    high = lookup(F.col(appliance), {k: v[1] for k, v in ranges.items()})
    return df.withColumns(
        {"range_min": low, "range_max": high, "in_range": F.col(value).cast("double").between(low, high)}
    )


def risk_drivers(paired: DataFrame, keys: list[str], appliance: str = "appliance") -> DataFrame:
    """Share of each appliance in the change of its key's total, largest increase first.

    ``paired`` has prev_kwh and next_kwh per key and appliance. The share is zero if the total did not
    change.
    """
    delta = F.round(F.col("next_kwh") - F.col("prev_kwh"), 6)
    by_key = Window.partitionBy(*keys)
    return (
        paired.withColumn("delta_kwh", delta)
        .withColumn("total_delta_kwh", F.round(F.sum("delta_kwh").over(by_key), 6))
        .withColumn(
            "driver_share", F.coalesce(F.try_divide(F.col("delta_kwh"), F.col("total_delta_kwh")), F.lit(0.0))
        )
        .withColumn("driver_rank", F.row_number().over(by_key.orderBy(F.col("delta_kwh").desc(), appliance)))
    )


def forecast_error(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute and root mean square error."""
    r = F.col("residual")
    return residuals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(r)).alias("mae"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        F.avg(r).alias("bias"),
    )


def month_end_projection(
    hourly: DataFrame, keys: list[str], tariff: float, cutoff_day: int = 20,
    slot: str = "slot_ts", value: str = "kwh",
) -> DataFrame:
    """Cost of a month from its first ``cutoff_day`` days: cost so far plus, for the remaining days,
    the mean of each hour of day so far. An hour without a row used no energy. One shuffle.
    """
    past = F.when(F.dayofmonth(slot) <= cutoff_day, F.col(value))
    month = F.date_format(slot, "yyyy-MM")
    remaining = F.dayofmonth(F.last_day(F.to_date("month", "yyyy-MM"))) - F.lit(cutoff_day)
    # The means of all 24 hours add up to the daily mean, so their sum needs no hour column.
    return (
        hourly.groupBy(*keys, month.alias("month"))
        .agg(F.coalesce(F.sum(past).cast("double"), F.lit(0.0)).alias("kwh_to_date"))
        .withColumn("cost_to_date", F.col("kwh_to_date") * F.lit(float(tariff)))
        .withColumn(
            "projected_cost",
            F.col("cost_to_date") + F.col("cost_to_date") / F.lit(float(cutoff_day)) * remaining,
        )
    )


def month_end_forecast(
    hourly: DataFrame, keys: list[str], tariff: float, cutoff: Column, tz: str | Column = "UTC",
    slot: str = "slot_ts", value: str = "kwh",
) -> DataFrame:
    """Cost of the month of each key's ``cutoff`` (an instant, its own for every row of a key): what was used in the month
    before the cutoff, and for each hour that is left the mean of that hour of day over all days before it.

    Days and hours are those of the clock of ``tz``. A day before the cutoff without a row in an hour used no energy then;
    days count from the key's first row. The hours left are counted per hour of day, not listed. A key without a row
    before its cutoff has no row. Two shuffles, the second of 24 rows per key.
    """
    us, day_us = local(F.col(slot), tz), 24 * HOUR_US
    end = local(cutoff, tz)
    month = F.trunc(F.date_from_unix_date(F.floor(end / F.lit(day_us)).cast("int")), "month")
    rows = hourly.select(
        *keys, F.col(value).cast("double").alias("_kwh"), us.alias("_us"), end.alias("_end"), month.alias("_month"),
        F.pmod(F.floor(us / F.lit(HOUR_US)), F.lit(24)).alias("_hour"),
    ).where("_us < _end")
    start = F.unix_date("_month") * F.lit(day_us)
    by_hour = rows.groupBy(*keys, "_month", "_end", "_hour").agg(
        F.sum("_kwh").alias("_kwh"), F.sum(F.when(F.col("_us") >= start, F.col("_kwh"))).alias("_now"), F.min("_us").alias("_first")
    )
    # days of an hour before the cutoff, from the first one that the key has; hours of it that are left in the month
    first = F.min("_first").over(Window.partitionBy(*keys, "_month", "_end"))
    begins = F.col("_hour") * F.lit(HOUR_US)
    count = lambda at: F.ceil((at - begins) / F.lit(day_us))  # days whose hour begins before an instant
    month_end = F.unix_date(F.add_months("_month", 1)) * F.lit(day_us)
    days = count(F.col("_end")) - count(F.col("_first_of_key") - F.pmod(F.col("_first_of_key"), F.lit(day_us)))
    left = count(month_end) - count(F.col("_end"))
    return (
        by_hour.withColumn("_first_of_key", first)
        .groupBy(*keys, "_month")
        .agg(
            F.coalesce(F.sum("_now"), F.lit(0.0)).alias("kwh_to_date"),
            F.sum(F.col("_kwh") / days * left).alias("kwh_ahead"),
        )
        .select(
            *keys, F.date_format("_month", "yyyy-MM").alias("month"), "kwh_to_date", "kwh_ahead",
            (F.col("kwh_to_date") * F.lit(float(tariff))).alias("cost_to_date"),
            ((F.col("kwh_to_date") + F.col("kwh_ahead")) * F.lit(float(tariff))).alias("projected_cost"),
        )
    )


def best_hours(profile: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The ``k`` hours of day with the lowest mean load; ties go to the earlier hour."""
    by_load = Window.partitionBy(*keys).orderBy("mean_kwh", "hour")
    return profile.withColumn("rank", F.row_number().over(by_load)).filter(F.col("rank") <= k)


def always_on(
    hourly: DataFrame, keys: list[str], floor: float, threshold: float, slot: str = "slot_ts", value: str = "kwh",
    tz: str | Column | None = None,
) -> DataFrame:
    """Share of a local day's 24 hours with a load above ``floor``; flagged from ``threshold`` on.

    Hours without a row are below the floor, so no grid has to be built.
    """
    active = F.sum((F.col(value) > F.lit(floor)).cast("int"))
    return (
        hourly.groupBy(*keys, local_date(F.col(slot), tz).alias("day"))
        .agg(F.coalesce(active, F.lit(0)).alias("active_hours"))
        .withColumn("on_share", F.col("active_hours") / F.lit(24.0))
        .withColumn("is_always_on", F.col("on_share") >= F.lit(threshold))
    )
