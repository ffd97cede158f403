"""Fitted forecasts against numpy, rolling origins, local time, proration, runs, sketches and bucketed tables."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattledger.operators.backtest import errors_by_horizon, rolling_origins
from wattledger.operators.forecast import (
    best_hours,
    hour_profile,
    linear_trend,
    month_end_forecast,
    profile_forecast,
    seasonal_ar1,
    seasonal_armax,
    seasonal_arx,
    seasonal_naive,
)
from wattledger.operators.normalise import hourly_energy, interval_energy
from wattledger.operators.spans import continuous_runs, day_sketches, longest_runs, merged_quantiles, prorated_hours
from wattledger.plans.catalog import QUERIES
from wattledger.sources.sinks import write_bucketed_readings

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def series(spark, values, key="a", skip=()):
    rows = [(key, START + timedelta(hours=i), float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "k string, slot_ts timestamp, kwh double")


def planted(n, phi, theta, c, sigma, seed):
    """Values whose seasonal difference has one lag and one moving-average term."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, sigma, n)
    d = np.zeros(n)
    for t in range(1, n):
        d[t] = c + phi * d[t - 1] + e[t] + theta * e[t - 1]
    y = np.zeros(n)
    for t in range(n):
        y[t] = (y[t - 24] if t >= 24 else 5.0) + d[t]
    return y


def test_planted_coefficients_are_found(spark):
    y = planted(9000, 0.6, 0.3, 0.02, 1.0, 3)
    row = seasonal_armax(series(spark, y), ["k"], ar=1, ma=1, long=12).where("step = 1").first()
    c, phi, theta = row.coefficients
    assert abs(phi - 0.6) < 0.06 and abs(theta - 0.3) < 0.06 and abs(c - 0.02) < 0.05 and abs(row.sigma - 1) < 0.05
    for found, true, error in zip(row.coefficients, (0.02, 0.6, 0.3), row.std_errors):
        assert 0 < error < 0.05 and abs(found - true) < 5 * error
    better = seasonal_armax(series(spark, y), ["k"], ar=1, ma=0, long=12).where("step = 1").first()
    assert row.sigma < better.sigma  # the moving-average term explains more


def test_two_regressions_equal_numpy(spark):
    y = planted(400, 0.5, -0.2, 0.1, 0.7, 4)
    got = seasonal_armax(series(spark, y), ["k"], {"even": lambda ts: (F.hour(ts) % 2 == 0)}, ar=2, ma=1, long=3).orderBy("step").collect()
    d = y[24:] - y[:-24]
    rows = np.arange(3, len(d))
    first = np.column_stack([np.ones(len(rows)), *(d[rows - i] for i in (1, 2, 3))])
    e = np.full(len(d), np.nan)
    e[rows] = d[rows] - first @ np.linalg.lstsq(first, d[rows], rcond=None)[0]
    rows = np.arange(4, len(d))
    even = ((np.arange(len(y))[24:] % 24) % 2 == 0).astype(float)
    x = np.column_stack([np.ones(len(rows)), d[rows - 1], d[rows - 2], e[rows - 1], even[rows]])
    beta, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
    rest = d[rows] - x @ beta
    errors = np.sqrt(rest @ rest / (len(rows) - 5) * np.diag(np.linalg.inv(x.T @ x)))
    assert got[0].n_rows == len(rows)
    assert np.allclose(got[0].coefficients, beta, atol=1e-6) and np.allclose(got[0].std_errors, errors, rtol=1e-5)
    known, shock, last = [d[-1], d[-2]], e[-1], len(y) - 1
    for row in got:
        step = beta[0] + beta[1] * known[0] + beta[2] * known[1] + beta[3] * shock + beta[4] * (((last + row.step) % 24) % 2 == 0)
        assert abs(row.forecast_kwh - (y[last + row.step - 24] + step)) < 1e-6
        known, shock = [step, known[0]], 0.0


def test_holes_take_no_part_in_a_fit(spark):
    y = planted(300, 0.5, 0.0, 0.1, 0.5, 5)
    holes = {100, 101, 180}
    got = seasonal_arx(series(spark, y, skip=holes), ["k"], {}, lags=1).where("step = 1").first()
    d = {t: y[t] - y[t - 24] for t in range(24, 300) if t not in holes and t - 24 not in holes}
    pairs = [(d[t - 1], d[t]) for t in d if t - 1 in d]
    x = np.column_stack([np.ones(len(pairs)), [p[0] for p in pairs]])
    beta = np.linalg.lstsq(x, np.array([p[1] for p in pairs]), rcond=None)[0]
    assert got.n_rows == len(pairs) and np.allclose(got.coefficients, beta, atol=1e-8)
    one = seasonal_ar1(series(spark, y, skip=holes), ["k"]).where("step = 1").first()
    assert abs(one.phi - beta[1]) < 1e-8 and abs(one.c - beta[0]) < 1e-8


def test_short_and_constant_keys(spark):
    short, flat = series(spark, [1.0] * 10, "short"), series(spark, [2.0] * 200, "flat")
    got = seasonal_armax(short.unionByName(flat), ["k"]).collect()
    assert len(got) == 48
    assert all(r.forecast_kwh is None and r.n_rows == 0 for r in got if r.k == "short")
    assert all(abs(r.forecast_kwh - 2.0) < 1e-9 for r in got if r.k == "flat")
    assert seasonal_armax(short.limit(0), ["k"]).count() == 0


def test_every_origin_equals_a_fit_of_what_it_knew(spark):
    rng = np.random.default_rng(6)
    y = 5 + np.sin(np.arange(200) / 24 * 2 * np.pi) + np.cumsum(rng.normal(0, 0.2, 200))
    tested = {(r.model, r.origin, r.horizon): r for r in rolling_origins(series(spark, y), ["k"], every=30, history=80).collect()}
    origins = sorted({k[1] for k in tested})
    assert len(origins) == 4 and len(tested) == 4 * 24 * 4 - 4 * 24 + 4 * len([h for h in range(1, 25) if 79 + 90 + h < 200])
    for origin in origins:
        n = int((origin.replace(tzinfo=timezone.utc) - START).total_seconds() // 3600) + 1
        known = series(spark, y[:n])
        models = {
            "naive": seasonal_naive(known, ["k"]).withColumnRenamed("kwh", "forecast_kwh"),
            "profile": profile_forecast(known, ["k"], 24, tz="UTC"),
            "trend": linear_trend(known, ["k"], 24),
            "ar1": seasonal_ar1(known, ["k"]),
        }
        for model, ahead in models.items():
            for r in ahead.select("slot_ts", "forecast_kwh").collect():
                h = int((r.slot_ts - origin).total_seconds() // 3600)
                if 1 <= h <= 24 and n - 1 + h < 200:
                    found = tested[model, origin, h]
                    assert abs(found.forecast_kwh - r.forecast_kwh) < 1e-6 and found.actual_kwh == y[n - 1 + h]
    errors = {(r.model, r.horizon): r for r in errors_by_horizon(rolling_origins(series(spark, y), ["k"], every=30, history=80), ["k"]).collect()}
    mine = [abs(r.actual_kwh - r.forecast_kwh) for k, r in tested.items() if k[0] == "ar1" and k[2] == 5]
    assert abs(errors["ar1", 5].mae - np.mean(mine)) < 1e-9 and errors["ar1", 5].n == len(mine)


def test_local_hours_do_not_depend_on_the_session(spark):
    hours = series(spark, [1.0 if (i + 8) % 24 == 3 else 9.0 for i in range(96)])
    before = spark.conf.get("spark.sql.session.timeZone")
    found = []
    try:
        for zone in ("UTC", "Asia/Manila", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.append([(r.hour, r.mean_kwh) for r in best_hours(hour_profile(hours, ["k"], tz="Asia/Manila"), ["k"], 1).collect()])
            own = best_hours(hour_profile(hours, ["k"]), ["k"], 1).first().hour  # without a zone: the session's clock
            assert own == {"UTC": 19, "Asia/Manila": 3, "America/New_York": 14}[zone]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == [[(3, 1.0)]] * 3


def test_queries_leave_the_callers_zone_alone(spark, small):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Manila")
        manila = sorted(map(str, QUERIES["hour_profile"](spark, small).collect()))
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Manila"
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert manila == sorted(map(str, QUERIES["hour_profile"](spark, small).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("tz, offset", [("UTC", 0), ("Asia/Manila", 8), ("Asia/Kolkata", 5.5)])
def test_month_end_counts_every_hour_left(spark, tz, offset):
    rng = random.Random(7)
    values = [rng.random() for _ in range(500)]
    skip = set(rng.sample(range(500), 60))
    cutoff = START + timedelta(hours=450)
    got = month_end_forecast(series(spark, values, skip=skip), ["k"], 2.0, F.lit(cutoff), tz).first()
    local = lambda i: START + timedelta(hours=i + offset)
    known = {i: values[i] for i in range(450) if i not in skip}
    days = (local(450) - local(0).replace(hour=0, minute=0)).total_seconds() / 86400
    ahead = 0.0
    for hour in range(24):
        past = sum(v for i, v in known.items() if local(i).hour == hour)
        begins = [local(0).replace(hour=hour, minute=0) + timedelta(days=k) for k in range(-1, int(days) + 2)]
        n = sum(local(0).replace(hour=0, minute=0) <= b < local(450) for b in begins)
        left = sum(local(450) <= datetime(2024, 1, d, hour, tzinfo=timezone.utc) for d in range(1, 32))
        ahead += past / n * left
    assert got.month == "2024-01" and abs(got.kwh_ahead - ahead) < 1e-9
    to_date = sum(v for i, v in known.items() if local(i).month == 1)
    assert abs(got.kwh_to_date - to_date) < 1e-9 and abs(got.projected_cost - 2 * (to_date + ahead)) < 1e-9


def test_hours_of_an_interval_add_up_to_it(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), START + timedelta(seconds=rng.randrange(10**6), microseconds=rng.randrange(10**6)), rng.choice([0.0, 1.0, 600.5, 3600.0, 86400.0, 250_000.25]), rng.random() * 10)
            for _ in range(200)]
    rows += [("a", START, 7200.0, 1.0), ("a", START + timedelta(hours=1), None, 2.0), ("b", START, 60.0, None), ("b", None, 60.0, 1.0), (None, START, 1800.0, 4.0)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp, interval_seconds double, energy_final_kwh double")
    got = prorated_hours(frame, ["k"]).collect()
    for key in ("a", "b", None):
        whole = sum(round(e * 1e6) for k, t, _, e in rows if k == key and e is not None and t is not None)
        assert round(sum(r.kwh for r in got if r.k == key) * 1e6) == whole
    alone = prorated_hours(spark.createDataFrame([("x", START + timedelta(minutes=90), 7200.0, 1.0)], frame.schema), ["k"])
    assert {(r.slot_ts.replace(tzinfo=timezone.utc) - START).total_seconds() / 3600: r.kwh for r in alone.collect()} == {-1.0: 0.25, 0.0: 0.5, 1.0: 0.25}
    edge = prorated_hours(spark.createDataFrame([("x", START + timedelta(hours=2), 3600.0, 3.0)], frame.schema), ["k"])
    assert [(r.slot_ts.replace(tzinfo=timezone.utc), r.kwh) for r in edge.collect()] == [(START + timedelta(hours=1), 3.0)]


@pytest.mark.parametrize("piece_rows", [10**9, 40, 5])
def test_runs_go_on_across_cuts(spark, piece_rows):
    rng = random.Random(11)
    rows, on = [], True
    for i in range(900):
        on = on if rng.random() < 0.93 else not on
        for key in ("hot", "b") if i % 3 == 0 else ("hot",):
            if rng.random() < 0.97:
                rows.append((key, START + timedelta(hours=i), 60.0 if on else 1.0))
    frame = spark.createDataFrame(rows, "k string, slot_ts timestamp, kwh double")
    runs = continuous_runs(frame, ["k"], F.col("kwh") > 50, piece_rows=piece_rows, piece_seconds=86400)
    got = {r.k: (r.n_runs, r.run_hours, r.first_ts.replace(tzinfo=timezone.utc)) for r in longest_runs(runs, ["k"]).collect()}
    for key in ("hot", "b"):
        times = sorted(t for k, t, v in rows if k == key and v > 50)
        found, first = [], times[0]
        for a, b in zip(times, [*times[1:], None]):
            if b is None or b - a > timedelta(hours=1):
                found.append(((a - first).total_seconds() / 3600 + 1, first))
                first = b
        best = max(found, key=lambda r: (r[0], -r[1].timestamp()))
        assert got[key] == (len(found), best[0], best[1])


def test_merged_sketches_keep_their_bound(spark):
    rng = np.random.default_rng(12)
    values = np.concatenate([rng.lognormal(0, 1, 20_000), np.full(3000, 5.0)])
    rng.shuffle(values)
    rows = spark.createDataFrame([("a", START + timedelta(minutes=int(i)), float(v)) for i, v in enumerate(values)], "k string, ts timestamp, v double")
    sketches = day_sketches(rows, "k", "v")
    assert sketches.count() == 16
    got = merged_quantiles(sketches, ["k"], [0.5, 0.9, 0.99]).first()
    assert got.n == len(values)
    for share in (0.5, 0.9, 0.99):
        limit = got[f"q{share * 100:g}"]
        assert (values < limit).mean() - 0.01 <= share <= (values <= limit).mean() + 0.01


def test_buckets_need_no_exchange(spark, small, tmp_path):
    from wattledger.plans.tables import counter_readings

    rows = counter_readings(spark, small)
    write_bucketed_readings(rows, "bucketed_counters", 4, path=str(tmp_path / "buckets"))
    try:
        table = spark.table("bucketed_counters")
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            energy = interval_energy(table, tie=["event_id"], max_gap_seconds=86400)
            hours = hourly_energy(table.withColumn("kwh", F.col("kwh_total")), ["device_id"])
            both = energy.join(hours.groupBy("device_id").agg(F.sum("n_readings").alias("n")), "device_id")
            for frame in (energy, hours, both):
                assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
            want = interval_energy(rows, tie=["event_id"], max_gap_seconds=86400)
            columns = ["event_id", "interval_seconds", "energy_final_kwh"]
            assert sorted(map(str, energy.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    finally:
        spark.sql("DROP TABLE bucketed_counters")
