"""Streams over several files give the batch results."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tests import twins
from wattledger.operators.alerts import alert_cooldown
from wattledger.operators.normalise import interval_energy
from wattledger.plans import streams
from wattledger.plans.catalog import QUERIES, SQL_TWINS
from wattledger.plans.tables import alert_events, counter_readings, events, readings
from wattledger.session import ROCKSDB_PROVIDER
from wattledger.sources.sinks import write_alert_outbox, write_outbox_batch
from wattledger.streaming.alerts import last_sent_alerts, stream_alert_cooldown
from wattledger.streaming.carry import cooldown_step, interval_energy_step, run_carried
from wattledger.streaming.energy import hourly_sums, newest_readings, stream_hourly, stream_interval_energy
from wattledger.streaming.run import run_available, stream_events


@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """The events in four files of a quarter of the time each, oldest first."""
    folder = str(tmp_path_factory.mktemp("stream"))
    rows = events(spark, small)
    for i in range(4):
        week = rows.filter((F.dayofmonth("ts") > i * 8) & (F.dayofmonth("ts") <= i * 8 + 8))
        week.coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture(scope="module")
def shuffled(spark, small, tmp_path_factory):
    """The events in six files without any order of time."""
    folder = str(tmp_path_factory.mktemp("shuffled"))
    events(spark, small).repartition(6, F.xxhash64("event_id")).write.mode("append").parquet(folder)
    return folder


def source(spark, parts, files=1):
    return stream_events(spark, *os.path.split(parts), max_files_per_trigger=files)


def counters(spark, parts, files=1):
    rows = source(spark, parts, files)
    return rows.select("event_id", F.col("user_id").alias("device_id"), "ts", F.col("value").alias("kwh_total"), F.lit(40.0).alias("power_w"))


@pytest.mark.parametrize("files", [1, 3, 100])
def test_order_and_size_of_micro_batches_do_not_matter(spark, small, shuffled, files):
    rows = source(spark, shuffled, files).select(F.col("user_id").alias("device_id"), "ts", F.col("value").cast("decimal(18,2)").alias("kwh"))
    hours = hourly_sums(rows, ["device_id"])
    batch = readings(spark, small).groupBy("device_id", F.date_trunc("hour", "ts").alias("slot_ts")).agg(F.sum("kwh").cast("decimal(28,2)").alias("kwh"), F.count(F.lit(1)).alias("n_readings"))
    same(hours.drop("is_closed"), batch)
    got = run_carried(counters(spark, shuffled, files), interval_energy_step(86400), "carried").rows
    want = interval_energy(counter_readings(spark, small).withColumn("power_w", F.lit(40.0)), tie=["event_id"], max_gap_seconds=86400)
    same(got.select("event_id", "device_id", "interval_seconds", "kwh_interval_kwh", "energy_final_kwh"), want)


@pytest.mark.parametrize("files", [1, 3])
def test_results_and_late_rows_are_the_input(spark, small, shuffled, files):
    done = run_carried(counters(spark, shuffled, files), interval_energy_step(86400), "carried", lateness="1 hour")
    ids = [r.event_id for r in done.rows.select("event_id").collect()] + [r.event_id for r in done.late.select("event_id").collect()]
    assert sorted(ids) == sorted(r.event_id for r in events(spark, small).select("event_id").collect())
    assert done.late.count() > 0


def test_rows_within_the_lateness_are_put_in_order(spark, small, parts):
    done = run_carried(counters(spark, parts), interval_energy_step(86400), "carried", lateness="2 days")
    want = interval_energy(counter_readings(spark, small).withColumn("power_w", F.lit(40.0)), tie=["event_id"], max_gap_seconds=86400)
    assert done.late.count() == 0
    same(done.rows.select("event_id", "device_id", "interval_seconds", "kwh_interval_kwh", "energy_final_kwh"), want)


@pytest.mark.parametrize("name", ["stream_interval_energy", "stream_cooldown"])
def test_registered_queries_do_not_depend_on_the_order_of_files(spark, small, tmp_path, monkeypatch, name):
    folder = str(tmp_path)
    events(spark, small).repartition(6, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(streams, "stream_events", lambda spark, folder, **_: stream_events(spark, folder, max_files_per_trigger=1))
    got = twins.rows_of_spark(QUERIES[name](spark, folder))
    assert twins.difference(got, twins.rows_of_sql(twins.connect(small), SQL_TWINS[name])) is None


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="does not exist"):
        stream_events(spark, str(tmp_path), "absent.parquet")


def same(got, want):
    want = want.select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hourly_windows(spark, small, parts):
    rows = source(spark, parts).select(F.col("user_id").alias("device_id"), "ts", F.col("value").cast("decimal(18,2)").alias("kwh"))
    got = run_available(stream_hourly(rows, ["device_id"]), "hourly", state_partitions=2)
    end = events(spark, small).agg(F.max("ts").alias("m"))
    batch = readings(spark, small).groupBy("device_id", F.date_trunc("hour", "ts").alias("slot_ts")).agg(F.sum("kwh").alias("kwh"), F.count(F.lit(1)).alias("n_readings"))
    last = end.first().m
    same(got, batch.filter(F.col("slot_ts") + F.expr("INTERVAL 70 MINUTES") <= F.lit(last)))


@pytest.mark.parametrize("piece_rows", [10**9, 20])
def test_carried_interval_energy(spark, small, parts, piece_rows):
    rows = source(spark, parts).select("event_id", F.col("user_id").alias("device_id"), "ts", F.col("value").alias("kwh_total"), F.lit(40.0).alias("power_w"))
    got = run_carried(rows, interval_energy_step(86400, piece_rows=piece_rows), "carried").rows
    batch = interval_energy(counter_readings(spark, small).withColumn("power_w", F.lit(40.0)), tie=["event_id"], max_gap_seconds=86400)
    same(got.select("event_id", "device_id", "interval_seconds", "kwh_interval_kwh", "energy_final_kwh"), batch)


@pytest.mark.parametrize("piece_rows", [10**9, 5])
def test_carried_cooldown(spark, small, parts, piece_rows):
    kind = F.when(F.col("value") >= 80, "critical").when(F.col("value") >= 40, "warning")
    rows = source(spark, parts).select("event_id", F.col("user_id").alias("household"), "ts", kind.alias("alert_type"))
    got = run_carried(rows, cooldown_step(piece_rows=piece_rows), "carried").rows
    same(got.select("event_id", "household", "alert_type", "is_sent"), alert_cooldown(alert_events(spark, small), tie=["event_id"]))


def test_interval_energy_keeps_state_between_batches(spark, small, parts):
    rows = source(spark, parts).select("event_id", F.col("user_id").alias("device_id"), "ts", F.col("value").alias("kwh_total"), F.lit(40.0).alias("power_w"))
    got = run_available(stream_interval_energy(rows, max_gap_seconds=86400), "interval", state_partitions=2)
    batch = interval_energy(counter_readings(spark, small).withColumn("power_w", F.lit(40.0)), tie=["event_id"], max_gap_seconds=86400)
    same(got.select("event_id", "device_id", "interval_seconds", "kwh_interval_kwh", "energy_final_kwh"), batch)


def test_cooldown_keeps_state_between_batches(spark, small, parts):
    kind = F.when(F.col("value") >= 80, "critical").when(F.col("value") >= 40, "warning")
    rows = source(spark, parts).select("event_id", F.col("user_id").alias("household"), "ts", kind.alias("alert_type"))
    got = run_available(stream_alert_cooldown(rows), "cooldown", state_partitions=2)
    same(got.select("event_id", "household", "alert_type", "is_sent"), alert_cooldown(alert_events(spark, small), tie=["event_id"]))


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "outbox")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "household int, subject string")
    for batch_id in (0, 1, 1):
        write_outbox_batch(rows, batch_id, path)
    assert spark.read.parquet(path).count() == 4


def test_batch_outbox_appends(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "household int, subject string")
    for _ in range(2):
        write_alert_outbox(rows, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


@pytest.fixture(scope="module")
def later(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("later"))
    events(spark, small).filter(F.dayofmonth("ts") > 16).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_interval_energy_continues_a_batch(spark, small, later):
    whole = counter_readings(spark, small).withColumn("power_w", F.lit(40.0))
    backlog = whole.filter(F.dayofmonth("ts") <= 16)
    rows = source(spark, later).select("event_id", F.col("user_id").alias("device_id"), "ts", F.col("value").alias("kwh_total"), F.lit(40.0).alias("power_w"))
    got = run_available(stream_interval_energy(rows, newest=newest_readings(backlog)), "continued", state_partitions=2)
    batch = interval_energy(whole, tie=["event_id"]).filter(F.dayofmonth("ts") > 16)
    same(got.select("event_id", "device_id", "interval_seconds", "kwh_interval_kwh", "energy_final_kwh"), batch)


def test_cooldown_continues_a_batch(spark, small, later):
    whole = alert_events(spark, small)
    marked = alert_cooldown(whole.filter(F.dayofmonth("ts") <= 16), tie=["event_id"])
    kind = F.when(F.col("value") >= 80, "critical").when(F.col("value") >= 40, "warning")
    rows = source(spark, later).select("event_id", F.col("user_id").alias("household"), "ts", kind.alias("alert_type"))
    got = run_available(stream_alert_cooldown(rows, last_sent=last_sent_alerts(marked)), "continued", state_partitions=2)
    batch = alert_cooldown(whole, tie=["event_id"]).filter(F.dayofmonth("ts") > 16)
    same(got.select("event_id", "household", "alert_type", "is_sent"), batch)


def test_empty_input(spark, tmp_path):
    rows = source(spark, str(tmp_path)).select(F.col("user_id").alias("device_id"), "ts", F.col("value").alias("kwh"))
    assert run_available(stream_hourly(rows, ["device_id"]), "empty", state_partitions=1).count() == 0
    counters = source(spark, str(tmp_path)).select("event_id", F.col("user_id").alias("device_id"), "ts", F.col("value").alias("kwh_total"), F.lit(1.0).alias("power_w"))
    assert run_carried(counters, interval_energy_step(), "empty").rows.count() == 0


def test_state_with_expiry(spark, small, tmp_path):
    """With an expiry the stream never runs dry, so it is stopped once all rows are there."""
    rows = stream_events(spark, small).select("event_id", F.col("user_id").alias("device_id"), "ts", F.col("value").alias("kwh_total"), F.lit(1.0).alias("power_w"))
    rows = stream_interval_energy(rows, ttl_ms=3_600_000)
    seen = []
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = (
            rows.writeStream.foreachBatch(lambda batch, _: seen.append(batch.count()))
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(processingTime="1 second")
            .start()
        )
        deadline = time.monotonic() + 60
        while sum(seen) < 1000 and query.isActive and time.monotonic() < deadline:
            time.sleep(0.5)
        query.stop()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(seen) == spark.read.parquet(f"{small}/events.parquet").count()
