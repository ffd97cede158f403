"""Forecasts against numpy and on series whose parameters are known."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattledger.operators.forecast import (
    always_on,
    best_hours,
    deviation_flags,
    hour_profile,
    month_end_projection,
    profile_forecast,
    range_check,
    risk_drivers,
    seasonal_ar1,
    seasonal_arx,
    seasonal_naive,
    with_residuals,
)

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def hourly(spark, values, key=1):
    rows = [(key, START + timedelta(hours=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "h int, slot_ts timestamp, kwh double")


def differences(n, coefficients, seed=1, noise=1.0, extra=None):
    """Series whose seasonal difference follows the given autoregression."""
    rng = np.random.default_rng(seed)
    lags = len(coefficients) - 1
    d = np.zeros(n)
    for t in range(lags, n):
        d[t] = coefficients[0] + sum(c * d[t - i - 1] for i, c in enumerate(coefficients[1:])) + rng.normal(0, noise)
        if extra is not None:
            d[t] += extra[t]
    y = np.full(n, 100.0)
    for t in range(24, n):
        y[t] = y[t - 24] + d[t]
    return y


@pytest.mark.parametrize("horizon", [6, 24, 60])
def test_naive_repeats_the_last_season(spark, horizon):
    y = np.arange(72.0)
    got = {r.slot_ts: r.kwh for r in seasonal_naive(hourly(spark, y), ["h"], horizon=horizon).collect()}
    end = datetime(2024, 1, 4)
    ahead = [got[end + timedelta(hours=j)] for j in range(horizon)]
    assert ahead == [48.0 + j % 24 for j in range(horizon)]
    assert got[datetime(2024, 1, 2)] == 0.0 and len(got) == 48 + horizon


def test_ar1_matches_least_squares(spark):
    y = differences(600, [0.5, 0.6])
    rows = seasonal_ar1(hourly(spark, y), ["h"]).orderBy("step").collect()
    d = y[24:] - y[:-24]
    slope, intercept = np.polyfit(d[:-1], d[1:], 1)
    assert rows[0].phi == pytest.approx(slope) and rows[0].c == pytest.approx(intercept)
    known = d[-1]
    for j, r in enumerate(rows):
        known = intercept + slope * known
        assert r.forecast_kwh == pytest.approx(y[len(y) - 24 + j] + known)
    with pytest.raises(ValueError):
        seasonal_ar1(hourly(spark, y), ["h"], horizon=25)


def test_arx_matches_least_squares(spark):
    hours = np.arange(800)
    evening = ((hours % 24) >= 18).astype(float)
    y = differences(800, [0.2, 0.5, -0.3], extra=2.0 * evening)
    exog = {"evening": lambda ts: (F.hour(ts) >= 18).cast("double")}
    rows = seasonal_arx(hourly(spark, y), ["h"], exog, lags=2).orderBy("step").collect()
    d = y[24:] - y[:-24]
    x = np.column_stack([np.ones(len(d) - 2), d[1:-1], d[:-2], evening[26:]])
    beta = np.linalg.lstsq(x, d[2:], rcond=None)[0]
    assert rows[0].coefficients == pytest.approx(beta.tolist()) and rows[0].n_rows == len(d) - 2
    last, before = d[-1], d[-2]
    for j, r in enumerate(rows):
        step = beta @ [1.0, last, before, float((800 + j) % 24 >= 18)]
        last, before = step, last
        assert r.forecast_kwh == pytest.approx(y[800 - 24 + j] + step)


def test_arx_without_regressors_equals_ar1(spark):
    series = hourly(spark, differences(400, [0.1, 0.4]))
    one = [r.forecast_kwh for r in seasonal_ar1(series, ["h"]).orderBy("step").collect()]
    many = [r.forecast_kwh for r in seasonal_arx(series, ["h"], {}, lags=1).orderBy("step").collect()]
    assert many == pytest.approx(one)


def test_profile_and_best_hours(spark):
    y = np.tile(np.arange(24.0)[::-1], 4)
    profile = hour_profile(hourly(spark, y), ["h"])
    assert {r.hour: r.mean_kwh for r in profile.collect()} == {h: 23.0 - h for h in range(24)}
    assert [r.hour for r in best_hours(profile, ["h"], 2).orderBy("rank").collect()] == [23, 22]
    ahead = profile_forecast(hourly(spark, y), ["h"], 3).orderBy("slot_ts").collect()
    assert [r.forecast_kwh for r in ahead] == [23.0, 22.0, 21.0]


def test_deviation(spark):
    y = np.full(24 * 12, 5.0)
    y[24 * 11 + 7] = 50.0
    series = hourly(spark, y)
    flagged = deviation_flags(with_residuals(series, seasonal_naive(series, ["h"]), ["h"]), ["h"]).filter("is_deviation").collect()
    assert [(r.hour, r.residual) for r in flagged] == [(7, 45.0)]


def test_range(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "appliance string, kwh double")
    got = [r.in_range for r in range_check(df, {"a": (0.5, 1.5)}).orderBy("appliance", "kwh").collect()]
    assert got == [True, False, None]


def test_risk_drivers(spark):
    df = spark.createDataFrame([(1, "a", 10.0, 16.0), (1, "b", 5.0, 3.0), (2, "a", 1.0, 1.0)], "h int, appliance string, prev_kwh double, next_kwh double")
    got = {(r.h, r.appliance): (r.driver_share, r.driver_rank) for r in risk_drivers(df, ["h"]).collect()}
    assert got == {(1, "a"): (1.5, 1), (1, "b"): (-0.5, 2), (2, "a"): (0.0, 1)}


def test_month_end(spark):
    row = month_end_projection(hourly(spark, np.full(25 * 24, 2.0)), ["h"], tariff=10.0).first()
    assert row.kwh_to_date == 20 * 48.0 and row.projected_cost == pytest.approx(31 * 480.0)


def test_always_on(spark):
    y = np.concatenate([np.full(24, 2.0), np.tile([2.0, 0.1], 12)])
    got = [(r.active_hours, r.is_always_on) for r in always_on(hourly(spark, y), ["h"], 0.5, 0.9).orderBy("day").collect()]
    assert got == [(24, True), (12, False)]
