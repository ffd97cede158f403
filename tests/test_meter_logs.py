from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wattledger.operators.normalise import (
    dense_hours,
    energy_columns,
    fill_gaps,
    gap_report,
    interval_energy,
    scale_raw,
    with_power_factor,
)
from wattledger.sources.meter_logs import (
    read_meter_log_v1,
    read_meter_log_v2,
    unify_generations,
    write_meter_log_v2,
)
from wattledger.sources.sinks import read_readings, write_readings

LINES_V1 = """timestamp,device_id,voltage_v,current_a,power_w,kwh_total,switch_1
2025-10-06T23:00:00+08:00,dev1,2300,180,400,21,True
2025-10-11T22:00:00+08:00,dev1,2310,0,0,1,,True
2025-10-11T22:01:00+08:00,dev1,2320,0,0,1,0,False
broken,line
"""

# Raw integers, interval and the derived columns of a recorded log.
RECORDED = [
    # voltage, current, power, counter, interval, step, fallback, final, power factor
    (2294, 158, 338, 1, None, None, None, None, 0.0932537273901096),
    (2316, 182, 420, 1, 600.757404, 0.0, 0.00700883638, 0.00700883638, 0.09964129135113589),
    (2316, 182, 420, 17, 600.630894, 0.16, 0.007007360430000001, 0.16, 0.09964129135113589),
    (2316, 182, 420, 20, 600.325692, 0.03, 0.0070037997399999994, 0.03, 0.09964129135113589),
    (2277, 0, 0, 1, None, None, None, None, 0.0),
    (2277, 0, 0, 1, 600.598254, 0.0, 0.0, 0.0, 0.0),
]


@pytest.fixture
def v1(spark, tmp_path):
    path = tmp_path / "v1.csv"
    path.write_text(LINES_V1)
    return read_meter_log_v1(spark, str(path))


def test_ragged_lines(v1):
    rows = v1.orderBy("ts").collect()
    assert [r.switch_1 for r in rows] == [True, True, False]
    assert [r.n_fields for r in rows] == [7, 8, 8]
    assert [r.interval_unnamed for r in rows] == [None, "", "0"]
    assert [r.add_ele_raw for r in rows] == [21, 1, 1]
    assert rows[0].ts.astimezone(timezone.utc).hour == 15


def test_recorded_derivation(spark):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(RECORDED)],
        "i int, voltage_raw bigint, current_raw bigint, power_raw bigint, add_ele_raw bigint, interval_seconds double, "
        "kwh_interval_kwh double, fallback double, final double, pf double",
    )
    for r in energy_columns(with_power_factor(scale_raw(df))).collect():
        assert r.pf_est == pytest.approx(r.pf, abs=1e-12)
        for got, want in ((r.energy_fallback_kwh, r.fallback), (r.energy_final_kwh, r.final)):
            assert (got is None) == (want is None)
            assert want is None or got == pytest.approx(want, abs=1e-12)
    assert scale_raw(df).filter("i = 1").first().voltage_v == 231.60000000000002


def test_intervals_runs_and_resets(spark):
    t = datetime(2025, 10, 12, 13, 48, 50, tzinfo=timezone.utc)
    rows = [(0, 0.01), (601, 0.01), (1202, 0.17), (1802, 0.10), (432000, 0.01), (432601, 0.05)]
    df = spark.createDataFrame([("d", t + timedelta(seconds=s), k, 42.0) for s, k in rows], "device_id string, ts timestamp, kwh_total double, power_w double")
    out = interval_energy(df, max_gap_seconds=86400, run_ids=True).orderBy("ts").collect()
    assert [r.interval_seconds for r in out] == [None, 601.0, 601.0, 600.0, None, 601.0]
    assert [r.run_id for r in out] == [1, 1, 1, 1, 2, 2]
    fallback = 42.0 / 1000 * 601 / 3600
    assert out[1].energy_final_kwh == pytest.approx(fallback)
    assert out[2].energy_final_kwh == pytest.approx(0.16)
    assert out[3].energy_final_kwh == pytest.approx(42.0 / 1000 * 600 / 3600)  # counter fell
    assert out[4].energy_final_kwh is None and out[5].energy_final_kwh == pytest.approx(0.04)


def test_gaps_count_missed_slots(spark):
    t = datetime(2025, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([("d", t + timedelta(minutes=m)) for m in (0, 1, 2, 3, 9, 10, 11)], "device_id string, ts timestamp")
    rows = gap_report(df).collect()
    assert [(r.seconds, r.cadence_seconds, r.missed_slots) for r in rows] == [(360, 60, 5)]


def test_dense_hours_and_fill(spark):
    t = datetime(2025, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([("d", t, 1.0), ("d", t + timedelta(hours=3), 4.0), ("e", t, 2.0)], "device_id string, slot_ts timestamp, kwh double")
    assert dense_hours(df, ["device_id"]).count() == 5
    rows = fill_gaps(df, ["device_id"]).filter("device_id = 'd'").orderBy("slot_ts").collect()
    assert [r.filled_kwh for r in rows] == [1.0, 1.0, 1.0, 4.0]
    assert [r.is_filled for r in rows] == [False, True, True, False]


def test_round_trip_and_union(spark, v1, tmp_path):
    v2 = scale_raw(v1).withColumnRenamed("ts", "timestamp")
    missing = F.lit(None).cast("double")
    v2 = v2.withColumns({c: missing for c in ("interval_seconds", "kwh_interval_kwh", "energy_fallback_kwh", "energy_final_kwh", "pf_est")})
    write_meter_log_v2(v2, str(tmp_path / "v2"))
    back = read_meter_log_v2(spark, str(tmp_path / "v2"))
    assert {tuple(r) for r in back.select("timestamp", "voltage_v", "switch_1").collect()} == {
        tuple(r) for r in v2.select("timestamp", "voltage_v", "switch_1").collect()
    }
    both = unify_generations(v1, back)
    assert both.count() == 6 and both.filter("generation = 1 and interval_seconds is null").count() == 3
    write_readings(both, str(tmp_path / "store"))
    assert read_readings(spark, str(tmp_path / "store"), first="2025-10-11").count() == 4
