"""Whole dashboard runs on the sample series, with totals worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from wattledger.constants import (
    ACTUAL_BASE,
    ACTUAL_INCREMENT,
    APPLIANCES,
    DEFAULT_BUDGET,
    DEFAULT_TARIFF,
    TOP_PRIORITY,
)
from wattledger.operators.budget import budget_status, status_badge, usage_ratio
from wattledger.operators.cost import (
    change_pct,
    comparison_long,
    period_comparison,
    ranking,
    scenario_costs,
    segment_totals,
    top_appliance,
    totals_with_grand_total,
    valid_scenario,
    with_costs,
    with_scenarios,
)
from wattledger.operators.forecast import forecast_error, linear_trend
from wattledger.operators.series import (
    configured_without_series,
    disaggregate,
    fit_length,
    source_priority,
)
from wattledger.sources.sample_dataset import (
    SERIES_APPLIANCE,
    appliance_ranges,
    configured_appliances,
    read_sample_dataset,
    sample_series,
)

# The first eight hours of the sample series, and the one-hour sample.
ACTUAL = [4.2, 4.35, 4.52, 4.68, 4.83, 4.95, 5.12, 5.28]
FORECAST = [4.1, 4.28, 4.49, 4.62, 4.78, 4.91, 5.08, 5.24]
COOLING = [2.45, 2.52, 2.38, 2.61, 2.43, 2.56, 2.41, 2.58]
FRIDGE = [1.23, 1.18, 1.29, 1.22, 1.26, 1.19, 1.31, 1.24]
WASHING = [0.82, 0.79, 0.85, 0.81, 0.84, 0.78, 0.86, 0.83]
FAN_KWH = 0.15


def period(n, past=None):
    actual, forecast = past or (ACTUAL[:n], FORECAST[:n])
    return {
        "lookback": {"actual": actual, "forecast": forecast, "labels": []},
        "forecast": {"ac": COOLING[:n], "refrigerator": FRIDGE[:n], "washingMachine": WASHING[:n], "labels": []},
    }


DOCUMENT = {
    "settings": {"defaultTariff": 13.47, "defaultBudget": 300, "appliances": ["Electric Fan", "Rice Cooker", "Television", "Air Conditioner", "Refrigerator", "Washing Machine"]},
    "applianceRanges": {"Air Conditioner": {"min": 2.2, "max": 2.8}, "Refrigerator": {"min": 1.1, "max": 1.4}, "Washing Machine": {"min": 0.7, "max": 0.9}},
    "sampleData": {"1hour": period(1, ([4.35, 4.52], [4.28, 4.49])), "4hours": period(4), "8hours": period(8)},
    "actualBaseValue": 4.2, "actualIncrement": 0.15, "actualRandomRange": 0.8,
    "forecastBaseValue": 4.1, "forecastIncrement": 0.15, "forecastRandomRange": 0.9,
}


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sample") / "sample.json"
    path.write_text(json.dumps(DOCUMENT, indent=2))
    return read_sample_dataset(spark, str(path)).cache()


@pytest.fixture(scope="module")
def series(dataset):
    return sample_series(dataset).cache()


@pytest.fixture(scope="module")
def future(series):
    """Three live appliances; the fan is absent from the sample and has a constant level."""
    name = F.lit(None).cast("string")
    for key, appliance in SERIES_APPLIANCE.items():
        name = F.when(F.col("series") == key, F.lit(appliance)).otherwise(name)
    measured = series.filter("segment = 'forecast'").select("period", "slot", name.alias("appliance"), "kwh")
    fan = measured.filter("appliance = 'Air Conditioner'").select("period", "slot", F.lit("Electric Fan").alias("appliance"), F.lit(FAN_KWH).alias("kwh"))
    return measured.filter(F.col("appliance").isin(APPLIANCES)).unionByName(fan).cache()


def test_long_series(series):
    assert series.count() == (2 * 2 + 3) + (2 * 4 + 3 * 4) + (2 * 8 + 3 * 8)
    assert series.filter("series = 'electricFan'").count() == 0
    row = series.filter("period = '4hours' and series = 'actual' and slot = 3").first()
    assert (row.segment, row.kwh) == ("lookback", 4.68)


def test_configuration(dataset):
    assert {r.appliance for r in appliance_ranges(dataset).collect()} == {"Air Conditioner", "Refrigerator", "Washing Machine"}
    assert configured_appliances(dataset).count() == 6


GOLDEN = {
    # period: past actual, next kWh, cost, ratio, badge, change
    "1hour": (8.87, 3.83, 51.5901, 0.1720, "success", -56.8207),
    "4hours": (17.75, 15.48, 208.5156, 0.6951, "success", -12.7887),
    "8hours": (37.93, 31.06, 418.3782, 1.3946, "danger", -18.1123),
}


def test_totals_costs_and_status(series, future):
    past = series.filter("series = 'actual'").select("period", F.lit("prev").alias("segment"), "kwh")
    totals = segment_totals(past.unionByName(future.select("period", F.lit("next").alias("segment"), "kwh")), ["period"])
    cost, budget = F.col("next_cost"), F.lit(DEFAULT_BUDGET)
    out = with_costs(totals, DEFAULT_TARIFF).withColumns(
        {"ratio": usage_ratio(cost, budget), "badge": status_badge(cost, budget), "two_way": budget_status(cost, budget), "change": change_pct(F.col("prev_kwh"), F.col("next_kwh"))}
    )
    for r in out.collect():
        prev, nxt, php, ratio, badge, change = GOLDEN[r.period]
        assert r.prev_kwh == pytest.approx(prev) and r.next_kwh == pytest.approx(nxt)
        assert r.next_cost == pytest.approx(php, abs=1e-4) and r.ratio == pytest.approx(ratio, abs=1e-4)
        assert r.badge == badge and r.change == pytest.approx(change, abs=1e-4)
        assert r.two_way == ("OK" if php < DEFAULT_BUDGET else "At-Risk")
    assert len(comparison_long(with_costs(totals, 1.0), ["period"]).collect()) == 12
    trend = {r.period: r.trend for r in period_comparison(with_costs(totals, 1.0)).collect()}
    assert set(trend.values()) == {"decrease"}


def test_forecast_error(series):
    wide = series.filter("segment = 'lookback'").groupBy("period", "slot").pivot("series", ["actual", "forecast"]).agg(F.first("kwh"))
    errors = forecast_error(wide.withColumn("residual", F.col("actual") - F.col("forecast")), ["period"])
    got = {r.period: r.mae for r in errors.collect()}
    assert got == pytest.approx({"1hour": 0.05, "4hours": 0.065, "8hours": 0.05375})


def test_ranking_and_top(future):
    costs = future.groupBy("period", "appliance").agg(F.sum("kwh").alias("kwh")).withColumn("php", F.col("kwh") * DEFAULT_TARIFF)
    ranked = ranking(costs, ["period"], APPLIANCES).filter("period = '4hours'").orderBy("rank").collect()
    assert [r.appliance for r in ranked] == ["Air Conditioner", "Refrigerator", "Electric Fan"]
    assert [r.rank_label for r in ranked] == ["1st", "2nd", "3rd"]
    assert sum(r.share_pct for r in ranked) == pytest.approx(100.0)
    total = totals_with_grand_total(future, ["period"], DEFAULT_TARIFF).filter("is_total = 1 and period = '8hours'").first()
    assert total.kwh == pytest.approx(31.06)


def test_ties_rank_and_top_disagree(spark):
    rows = spark.createDataFrame([(1, n, 5.0) for n in APPLIANCES], "h int, appliance string, php double")
    first = ranking(rows, ["h"], APPLIANCES).filter("rank = 1").first().appliance
    top = rows.groupBy("h").agg(top_appliance(F.col("appliance"), F.col("php"), TOP_PRIORITY).alias("t")).first().t
    assert (first, top) == ("Electric Fan", "Air Conditioner")


def test_short_sample_is_extended(series):
    actual = series.filter("period = '1hour' and series = 'actual'")
    rows = fit_length(actual, ["period"], 24, ACTUAL_BASE, ACTUAL_INCREMENT).orderBy("slot").collect()
    assert len(rows) == 24 and [r.kwh for r in rows[:2]] == [4.35, 4.52]
    assert rows[2].is_extended and rows[2].kwh == pytest.approx(4.2 + 2 * 0.15)
    cut = fit_length(series.filter("period = '8hours' and series = 'actual'"), ["period"], 3, 0.0, 0.0).orderBy("slot").collect()
    assert [r.kwh for r in cut] == ACTUAL[:3]


def test_source_priority(spark):
    df = spark.createDataFrame([("Air Conditioner", 2.45), ("Refrigerator", None), ("Electric Fan", None), ("Lamp", None)], "appliance string, v double")
    ranges = {k: (v["min"], v["max"]) for k, v in DOCUMENT["applianceRanges"].items()}
    got = {r.appliance: (r.kwh, r.source) for r in source_priority(df, "v", ranges).collect()}
    assert got == {"Air Conditioner": (2.45, "sample"), "Refrigerator": (1.25, "range"), "Electric Fan": (0.1, "constant"), "Lamp": (None, None)}


def test_configured_names_without_series(dataset, future):
    keyed = future.filter("period = '4hours'").withColumn("h", F.lit(1))
    configured = configured_appliances(dataset).withColumn("h", F.lit(1))
    assert {r.appliance for r in configured_without_series(keyed, configured, ["h"]).collect()} == {"Rice Cooker", "Television", "Washing Machine"}


def test_disaggregation_keeps_totals_and_nulls(spark):
    totals = spark.createDataFrame([(1, 0, 10.0), (1, 1, None), (2, 0, 7.0)], "h int, slot int, kwh double")
    weights = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "a", 0.0)], "h int, appliance string, app_kwh double")
    got = {(r.h, r.slot, r.appliance): r.app_actual_kwh for r in disaggregate(totals, weights, ["h"]).collect()}
    assert got == {(1, 0, "a"): 7.5, (1, 0, "b"): 2.5, (1, 1, "a"): None, (1, 1, "b"): None, (2, 0, "a"): 0.0}


def test_scenarios(spark):
    base = spark.createDataFrame([(100.0, 80.0)], "prev_kwh double, next_kwh double")
    rows = scenario_costs(with_scenarios(base, [("base", 13.47, 0), ("double", 26.94, 0), ("more", 13.47, 50)]), 13.47).collect()
    got = {r.scenario: r for r in rows}
    assert {r.prev_cost for r in rows} == {100.0 * 13.47}
    assert got["base"].next_cost == pytest.approx(80 * 13.47)
    assert got["double"].next_cost == pytest.approx(2 * got["base"].next_cost)
    assert got["more"].scaled_next_kwh == pytest.approx(120.0) and got["more"].next_kwh == 80.0
    checks = spark.createDataFrame([(5.0, -50), (30.0, 50), (4.99, 0), (30.01, 0), (13.0, 7), (13.0, 55), (None, 0)], "t double, p int")
    assert [r[0] for r in checks.select(valid_scenario(F.col("t"), F.col("p"))).collect()] == [True, True, False, False, False, False, False]


def test_trend_slope(spark):
    df = spark.sql("SELECT 1 AS h, timestamp_seconds(id * 3600) AS slot_ts, 2.0 + id * 0.25 AS kwh FROM range(48)")
    rows = linear_trend(df, ["h"], 2).orderBy("step").collect()
    assert rows[0].base == pytest.approx(2.0) and rows[0].increment == pytest.approx(0.25)
    assert [r.forecast_kwh for r in rows] == pytest.approx([2.0 + 48 * 0.25, 2.0 + 49 * 0.25])
