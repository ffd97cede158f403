"""What the plans must and must not contain."""

import re

import pytest

from wattledger.plans.catalog import QUERIES


WRITING = {"meter_v2_round_trip", "settings_latest", "alert_outbox", "stream_hourly", "stream_interval_energy", "stream_cooldown", "stream_interval_carried", "stream_cooldown_carried"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_product_joins_and_no_row_python(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert "SinglePartition" not in text


def test_lookback_reaches_the_scan(spark, small):
    text = plan(QUERIES["lookback_window"](spark, small))
    pushed = re.search(r"PushedFilters: \[([^\]]*)", text).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    assert "ReadSchema: struct<ts:timestamp,event_type:string,value:double>" in text


def test_flagship_reads_three_columns(spark, small):
    text = plan(QUERIES["flagship_budget_summary"](spark, small))
    assert "ReadSchema: struct<ts:timestamp,user_id:bigint,value:double>" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text


def test_ranking_reads_only_needed_columns(spark, small):
    text = plan(QUERIES["brand_ranking"](spark, small))
    assert "l_discount" not in text and "p_name" not in text


@pytest.mark.parametrize(("name", "scans"), [("disaggregate_actual", 1), ("appliance_overlay", 0)])
def test_overlays_reuse_the_sums_of_the_readings(spark, small, name, scans):
    """Weights and totals share one scan and shuffle; the overlay reads its stored hourly sums only."""
    df = QUERIES[name](spark, small)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    readings = [line for line in final.splitlines() if "FileScan parquet" in line and "props" not in line and "events.parquet" in line]
    assert len(readings) == scans and ("ReusedExchange" in final or not scans)
