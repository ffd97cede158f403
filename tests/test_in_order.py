"""Streams that their own state holds in order: any order of files, late rows, restarts."""

import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.operators.alerts import alert_cooldown
from wattledger.operators.normalise import interval_energy
from wattledger.plans.tables import alert_events, counter_readings, events
from wattledger.schemas import METER_LOG_V2
from wattledger.sources.meter_logs import counters as log_counters
from wattledger.sources.meter_logs import read_meter_log_v1, read_meter_log_v2, stream_meter_log_v1, stream_meter_log_v2
from wattledger.streaming.ordered import _Cooldown, _Energy, cooldown_in_order, energy_in_order, run_in_order
from wattledger.streaming.run import run_available, stream_events

ENERGY = ["event_id", "device_id", "interval_seconds", "kwh_interval_kwh", "energy_final_kwh"]


@pytest.fixture(scope="module")
def shuffled(spark, small, tmp_path_factory):
    """The events in six files without any order of time."""
    folder = str(tmp_path_factory.mktemp("in-order"))
    events(spark, small).repartition(6, F.xxhash64("event_id")).write.mode("append").parquet(folder)
    return folder


def counters(rows):
    return rows.select("event_id", F.col("user_id").alias("device_id"), "ts", F.col("value").alias("kwh_total"), F.lit(40.0).alias("power_w"))


def alerts(rows):
    kind = F.when(F.col("value") >= 80, "critical").when(F.col("value") >= 40, "warning")
    return rows.select("event_id", F.col("user_id").alias("household"), "ts", kind.alias("alert_type"))


def source(spark, folder, files):
    return stream_events(spark, *os.path.split(folder), max_files_per_trigger=files)


def text(frame, columns):
    return sorted(map(str, frame.select(*columns).collect()))


@pytest.mark.parametrize("files, bucket", [(1, "1 day"), (3, "1 day"), (100, "1 day"), (1, "10 days")])
def test_interval_energy_in_any_order_of_files(spark, small, shuffled, files, bucket):
    done = run_in_order(
        counters(source(spark, shuffled, files)), lambda s: energy_in_order(s, "60 days", max_gap_seconds=86400, bucket=bucket), "energy", state_partitions=2
    )
    want = interval_energy(counter_readings(spark, small).withColumn("power_w", F.lit(40.0)), tie=["event_id"], max_gap_seconds=86400)
    assert done.late.count() == 0
    assert text(done.rows, ENERGY) == text(want, ENERGY)


@pytest.mark.parametrize("files", [1, 3, 100])
def test_cooldown_in_any_order_of_files(spark, small, shuffled, files):
    done = run_in_order(alerts(source(spark, shuffled, files)), lambda s: cooldown_in_order(s, "60 days", bucket="5 days"), "cooldown", state_partitions=2)
    columns = ["event_id", "household", "alert_type", "is_sent"]
    assert done.late.count() == 0
    assert text(done.rows, columns) == text(alert_cooldown(alert_events(spark, small), tie=["event_id"]), columns)


def test_rows_leave_before_the_input_ends(spark, small, tmp_path):
    """Files in the order of time: what the watermark has passed is there before the end mark."""
    folder = str(tmp_path / "weeks")
    for week in range(4):
        rows = events(spark, small).filter((F.dayofmonth("ts") > week * 8) & (F.dayofmonth("ts") <= week * 8 + 8))
        rows.coalesce(1).write.mode("append").parquet(folder)
    operator = energy_in_order(counters(source(spark, folder, 1)), "1 day", bucket="1 day")
    got = run_available(operator, "early", state_partitions=2)
    newest = events(spark, small).agg(F.max("ts")).first()[0]
    assert 0.7 * 1000 < got.count() < 1000 and got.where("is_late").count() == 0
    assert got.agg(F.max("ts")).first()[0] < newest


def test_late_rows_leave_by_the_second_output(spark, small, shuffled):
    done = run_in_order(counters(source(spark, shuffled, 1)), lambda s: energy_in_order(s, "1 hour", bucket="1 hour"), "late", state_partitions=2)
    ids = [r.event_id for r in done.rows.select("event_id").collect()] + [r.event_id for r in done.late.select("event_id").collect()]
    assert sorted(ids) == sorted(r.event_id for r in events(spark, small).select("event_id").collect())
    assert done.late.count() > 0 and done.late.where("interval_seconds IS NOT NULL").count() == 0
    # the rows in time are as if the late ones had never been
    want = interval_energy(done.rows.select("event_id", "device_id", "ts", "kwh_total", "power_w"), tie=["event_id"])
    assert text(done.rows, ENERGY) == text(want, ENERGY)


def test_null_keys_and_times(spark, tmp_path):
    rows = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    data = [
        (1, "2024-01-01 00:00:00", None, "a", 10.0, None), (2, "2024-01-01 00:10:00", None, "a", 11.0, None), (3, "2024-01-01 00:05:00", 0, "a", 5.0, None),
        (4, None, 7, "a", 1.0, None), (5, "2024-01-02 00:00:00", 7, "a", None, None), (6, "2024-01-02 00:10:00", 7, "a", 3.0, None),
    ]
    frame = spark.createDataFrame(data, rows.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "events"))
    done = run_in_order(counters(source(spark, str(tmp_path / "events"), 1)), lambda s: energy_in_order(s, "1 day", max_gap_seconds=86400), "nulls", state_partitions=2)
    got = {r.event_id: (r.device_id, r.interval_seconds, r.kwh_interval_kwh) for r in done.rows.collect()}
    assert got == {1: (None, None, None), 2: (None, 600.0, 1.0), 3: (0, None, None), 4: (7, None, None), 5: (7, None, None), 6: (7, 600.0, None)}


def test_empty_input(spark, tmp_path):
    done = run_in_order(counters(source(spark, str(tmp_path), 1)), lambda s: energy_in_order(s, "1 day"), "empty", state_partitions=1)
    assert done.rows.count() == 0 and done.late.count() == 0


@pytest.mark.parametrize("generation", [1, 2])
def test_meter_logs_as_streams(spark, tmp_path, generation):
    """Log files that arrive in any order give the energy of the whole log."""
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = [(f"2025-10-0{d}T{h:02d}:{m:02d}:00+08:00", f"dev{k}", 40 * h + m, 400 + m) for d in (1, 2) for h in range(0, 24, 5) for m in (0, 10, 20) for k in (1, 2)]
    parts = [lines[k::4] for k in (2, 0, 3, 1)]
    for i, part in enumerate(parts):
        if generation == 1:
            text = ["timestamp,device_id,voltage_v,current_a,power_w,kwh_total,switch_1"]
            text += [f"{t},{d},2300,180,{w},{e},{'0,' if i % 2 else ''}True" for t, d, e, w in part]
        else:
            text = [",".join(f.name for f in METER_LOG_V2)]
            text += [f"{t},{d},True,2300,180,{w},{e},230.0,1.8,{w / 10},{e / 100},,,,," for t, d, e, w in part]
        (folder / f"log{i}.csv").write_text("\n".join(text) + "\n")
    read, stream = (read_meter_log_v1, stream_meter_log_v1) if generation == 1 else (read_meter_log_v2, stream_meter_log_v2)
    want = interval_energy(log_counters(read(spark, str(folder))), tie=["event_id"], max_gap_seconds=86400)
    rows = log_counters(stream(spark, str(folder), max_files_per_trigger=1))
    done = run_in_order(rows, lambda s: energy_in_order(s, "10 days", max_gap_seconds=86400, bucket="1 day"), "logs", state_partitions=2)
    assert done.rows.count() == len(lines) and done.late.count() == 0
    assert text_of(done.rows) == text_of(want)


def text_of(frame):
    rows = frame.select("event_id", "device_id", F.unix_micros("ts").alias("us"), "interval_seconds", "energy_final_kwh")
    return sorted(map(str, rows.collect()))


class Store:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def getMapState(self, *_):
        return _Map(self)

    def getValueState(self, *_):
        return _Map(self)


class _Map(dict):
    def __init__(self, store):
        self.store = store

    def __getattribute__(self, name):
        if name in ("getValue", "updateValue", "removeKey", "keys", "get", "update"):
            object.__getattribute__(self, "store").calls += 1
        return super().__getattribute__(name)

    def getValue(self, key):
        return dict.get(self, key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def keys(self):
        return list(self)

    def get(self):
        return dict.get(self, 0)

    def update(self, value):
        self[0] = value


def through(processor, parts, columns):
    """The parts of one group of keys, then every timer; the results, and the calls to the state store."""
    store = Store()
    processor.init(store)
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    found = [out for part in parts for out in processor.handleInputRows((0,), iter([part]), now)]
    for ms in sorted(store.timers):
        found += processor.handleExpiredTimer((0,), now, SimpleNamespace(getExpiryTimeInMs=lambda: ms))
    return pd.concat(found, ignore_index=True)[columns].sort_values("event_id", ignore_index=True), store.calls


def group_of_rows(n_keys, n_rows):
    """Rows of many keys, also null and before 1970, on few times, in three parts without order."""
    rng = np.random.default_rng(n_keys)
    key = rng.integers(0, n_keys, n_rows)
    pdf = pd.DataFrame({
        "key": np.where(key == 1, 0, key), "no_key": key == 1, "event_id": rng.permutation(n_rows), "no_id": False,
        "us": rng.integers(-6, 30, n_rows) * 3_600_000_000, "kwh_total": rng.integers(0, 9000, n_rows) / 100, "power_w": 40.0,
        "alert_type": rng.choice(["warning", "critical"], n_rows, p=[0.8, 0.2]),
    })
    pdf.loc[pdf["event_id"] % 50 == 0, "kwh_total"] = np.nan
    return pdf, [pdf[k::3] for k in (2, 0, 1)]


def fields_of(*last):
    first = ("key bigint", "no_key boolean", "event_id bigint", "no_id boolean", "us bigint")
    return T._parse_datatype_string(", ".join([*first, *last])).fields


@pytest.mark.parametrize("n_keys", [1, 7, 400])
def test_cooldown_of_a_group_of_keys(spark, n_keys):
    """As row by row, and with no more calls to the state store than for one key."""
    rows, parts = group_of_rows(n_keys, 3000)
    got, calls = through(_Cooldown(fields_of("alert_type string"), 6 * 3_600_000, 4 * 3_600_000_000), parts, ["event_id", "household", "is_sent"])
    want, last = {}, {}
    for r in rows.sort_values(["us", "event_id"]).itertuples():
        before = last.get((r.key, r.no_key))
        want[r.event_id] = before is None or r.alert_type != before[0] or r.us - before[1] > 4 * 3_600_000_000
        if want[r.event_id]:
            last[r.key, r.no_key] = r.alert_type, r.us
    assert dict(zip(got["event_id"], got["is_sent"])) == want
    assert got["household"].isna().sum() == rows["no_key"].sum()
    assert calls < 150


@pytest.mark.parametrize("n_keys", [1, 7, 400])
def test_energy_of_a_group_of_keys(spark, n_keys):
    rows, parts = group_of_rows(n_keys, 3000)
    processor = _Energy(fields_of("kwh_total double", "power_w double"), 6 * 3_600_000, 7200)
    got, calls = through(processor, parts, ["event_id", "device_id", "interval_seconds", "kwh_interval_kwh"])
    rows = rows.sort_values(["us", "event_id"])
    by = rows.groupby(["key", "no_key"])
    seconds = by["us"].diff() / 1e6
    rows["seconds"] = seconds.where(seconds <= 7200)
    rows["kwh"] = by["kwh_total"].diff().round(6).where(seconds <= 7200)
    rows = rows.sort_values("event_id", ignore_index=True)
    np.testing.assert_array_equal(got["interval_seconds"], rows["seconds"])
    np.testing.assert_array_equal(got["kwh_interval_kwh"], rows["kwh"])
    assert got["device_id"].isna().sum() == rows["no_key"].sum() and calls < 150
