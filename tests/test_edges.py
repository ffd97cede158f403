"""Inputs at the edges: empty series, ties, broken requests and log lines, other time zones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattledger.functions.times import period_index, period_start
from wattledger.operators.alerts import clamp_thresholds, parse_threshold_requests, parse_welcome_requests, threshold_mail
from wattledger.operators.budget import mail_color, mail_status
from wattledger.operators.cost import valid_scenario
from wattledger.operators.forecast import seasonal_arx
from wattledger.operators.series import fit_length, slot_totals
from wattledger.sources.meter_logs import parse_meter_log_v1, read_meter_log_v2
from wattledger.sources.settings import read_settings, upsert_settings
from wattledger.sources.sinks import read_readings, write_readings


def test_series_of_every_key(spark):
    rows = [("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0), ("b", 9, 5.0), ("c", 0, None), ("a", 2, 2.0), ("x", 0, 1.0)]
    series = spark.createDataFrame(rows, "k string, slot int, kwh double")
    axis = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "k string")
    got = {(r.k, r.slot): (r.kwh, r.is_extended) for r in fit_length(series, ["k"], 4, 10.0, 1.0, axis=axis).collect()}
    assert {k for k, _ in got} == set("abcd") and len(got) == 16
    assert [got["a", s] for s in range(4)] == [(1.0, False), (None, False), (3.0, False), (13.0, True)]
    assert [got["b", s] for s in range(4)] == [got["d", s] for s in range(4)] == [(10.0 + s, True) for s in range(4)]
    assert [got["c", s] for s in range(4)] == [(None, False), (11.0, True), (12.0, True), (13.0, True)]
    assert {r.k for r in fit_length(series, ["k"], 4, 10.0, 1.0).collect()} == set("abcx")


def test_missing_appliances_are_counted(spark):
    rows = [(1, "ac", 1.0), (1, "fan", None), (2, "ac", 1.0), (2, "fan", 2.0), (2, "tv", 4.0)]
    got = slot_totals(spark.createDataFrame(rows, "slot_ts int, appliance string, kwh double"), [], expected=["ac", "fan", "tv"]).collect()
    assert {r.slot_ts: (r.total_kwh, r.n_missing) for r in got} == {1: (1.0, 2), 2: (7.0, 0)}


def test_thresholds_stay_in_their_range(spark):
    pairs = [(a, b) for a in (-5, 0, 60, 119, 120, 130) for b in (-5, 0, 1, 60, 120, 130)]
    df = spark.createDataFrame(pairs, "a int, b int")
    for moved in ("low", "high"):
        for r in df.select(clamp_thresholds(F.col("a"), F.col("b"), moved).alias("t")).collect():
            assert 0 <= r.t.approaching < r.t.critical <= 120


def test_mail_of_an_unknown_percent_and_an_exact_budget(spark):
    df = spark.createDataFrame([(None, 300.125, 1.0), (99, 300.0, 2.005), (100, 12345678.5, 3.0)], "usage_percent int, budget double, next_cost double")
    got = threshold_mail(df).collect()
    assert [r.status_text for r in got] == [None, "Approaching Limit", "Budget Exceeded"]
    assert [r.budget_line for r in got] == ["Set Budget: ₱300.125", "Set Budget: ₱300.0", "Set Budget: ₱12345678.5"]
    assert df.select(mail_status(F.col("usage_percent")), mail_color(F.col("usage_percent"))).first() == (None, None)


@pytest.mark.parametrize(
    ("body", "valid"),
    [('{"email": "a@b"}', True), ('{"meta": {"email": "x"}, "email": 5}', False), ('{"meta": {"email": "x"}}', False),
     ('{"email": null}', False), ('{"email": "a@b"', False), ("[]", False), (None, False)],
)
def test_addresses_are_texts_of_the_body_itself(spark, body, valid):
    df = spark.createDataFrame([(body,)], "body string")
    assert parse_welcome_requests(df).first().is_valid is valid
    if body is not None:
        full = body.replace("}", ', "usage_percent": 80, "budget": 1, "cost": 2}', 1) if body.count("}") == 1 else body[:-1] + ', "usage_percent": 80, "budget": 1, "cost": 2}'
        assert parse_threshold_requests(spark.createDataFrame([(full,)], "body string")).first().is_valid is valid


def test_tariff_steps(spark):
    df = spark.createDataFrame([(13.47,), (13.475,), (29.99,), (5.0,)], "t double")
    assert [r[0] for r in df.select(valid_scenario(F.col("t"), F.lit(5))).collect()] == [True, False, True, True]


def test_bad_log_lines_are_kept_apart(spark, tmp_path):
    lines = ["timestamp,device_id,a,b,c,d,e", "2025-10-06T23:00:00+08:00,dev1,2300,180,400,21,True", "too,short", "", "noon,dev1,1,1,1,1,True",
             "2025-10-06T23:01:00+08:00,dev1,2300,180,400,21,0,False"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = parse_meter_log_v1(df, quarantine=True).collect()
    assert len(got) == 5 and sorted(r.raw for r in got if not r.is_valid) == ["", "noon,dev1,1,1,1,1,True", "too,short"]
    (tmp_path / "log.csv").write_text("timestamp,device_id,switch_1\n2025-10-06T23:00:00+08:00,dev1,true\nnoon,dev1,maybe\n")
    rows = read_meter_log_v2(spark, str(tmp_path / "log.csv"), quarantine=True).collect()
    assert len(rows) == 2 and sum("noon" in (r.raw or "") for r in rows) == 1


def test_loading_one_day_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("d", dt.datetime(2024, 1, 1, 5), 1.0), ("d", dt.datetime(2024, 1, 2, 5), 2.0)]
    schema = "device_id string, ts timestamp, kwh double"
    write_readings(spark.createDataFrame(rows, schema), path)
    write_readings(spark.createDataFrame([("d", dt.datetime(2024, 1, 2, 6), 9.0)], schema), path)
    assert sorted(r.kwh for r in read_readings(spark, path).collect()) == [1.0, 9.0]


def test_settings_are_merged(spark, tmp_path):
    path = str(tmp_path / "settings")
    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    schema = "household int, ts timestamp, event_id int, currency string"
    upsert_settings(spark.createDataFrame([(1, at[1], 1, "PHP"), (1, at[1], 2, "USD"), (2, at[1], 3, "PHP")], schema), path, tie=["event_id"])
    upsert_settings(spark.createDataFrame([(1, at[0], 4, "EUR"), (2, at[1], 5, "EUR"), (3, at[2], 6, "EUR")], schema), path, tie=["event_id"])
    got = {r.household: r.currency for r in read_settings(spark, path).collect()}
    assert got == {1: "USD", 2: "EUR", 3: "EUR"}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Manila", "America/New_York"])
def test_days_follow_the_time_zone(spark, zone):
    df = spark.sql("SELECT explode(sequence(timestamp'2024-03-08 00:30:00', timestamp'2024-03-12 00:00:00', interval 1 hour)) AS ts")
    day = F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd")
    index = period_index(F.col("ts"), 24, zone)
    rows = df.select(day.alias("day"), index.alias("i"), period_start(index, 24, zone).alias("start"), "ts").collect()
    assert {(dt.date.fromisoformat(r.day) - dt.date(1970, 1, 1)).days - r.i for r in rows} == {0}
    assert all(r.start <= r.ts for r in rows)


def test_short_series_keep_their_steps(spark):
    hours = [("short", dt.datetime(2024, 1, 1, h), 1.0) for h in range(5)]
    got = seasonal_arx(spark.createDataFrame(hours, "h string, slot_ts timestamp, kwh double"), ["h"], {}, lags=1).collect()
    assert len(got) == 24 and all(r.forecast_kwh is None and r.n_rows == 0 for r in got)
