"""Cut keys give the same rows as a plain window."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattledger.operators.alerts import welcome_triggers
from wattledger.operators.normalise import gap_report, interval_energy
from wattledger.operators.ordered import (
    PIECE,
    WHOLE_KEY,
    cut_large_keys,
    with_previous,
    with_running_sum,
)

START = datetime(2024, 3, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def skewed(spark):
    """Device 1 holds more than a third of the rows, most of them in one burst; some times repeat."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        device = 1 if i % 5 < 2 else 2 + i % 23
        seconds = rng.randrange(1800) if device == 1 and i % 3 else rng.randrange(6 * 86400)
        if i % 17 == 0:
            seconds = 7200
        rows.append((i, device, START + timedelta(seconds=seconds), float(rng.randrange(40)), float(rng.randrange(90))))
    return spark.createDataFrame(rows, "event_id bigint, device_id bigint, ts timestamp, kwh_total double, power_w double").cache()


@pytest.mark.parametrize("piece_rows", [5, 40, 100])
def test_previous_and_running_sum(skewed, piece_rows):
    pieces = cut_large_keys(skewed, ["device_id"], "ts", piece_rows)
    assert pieces.cut
    order = ["ts", "event_id"]
    got = with_running_sum(with_previous(pieces, order, {"p": "event_id"}), order, "power_w", "s").result()
    w = Window.partitionBy("device_id").orderBy(*order)
    want = skewed.withColumn("p", F.lag("event_id").over(w)).withColumn(
        "s", F.sum("power_w").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    columns = ["event_id", "p", "s"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)


def test_rows_without_key_or_time(skewed):
    df = skewed.withColumn("device_id", F.when(F.col("device_id") != 1, F.col("device_id"))).withColumn(
        "ts", F.when(F.col("event_id") % 13 != 0, F.col("ts"))
    )
    pieces = cut_large_keys(df, ["device_id"], "ts", 40)
    got = with_previous(pieces, ["ts", "event_id"], {"p": "event_id"}).rows
    want = df.withColumn("p", F.lag("event_id").over(Window.partitionBy("device_id").orderBy("ts", "event_id")))
    assert pieces.rows.filter(F.col("device_id").isNull()).select(PIECE).distinct().count() > 8
    assert sorted(map(tuple, got.select("event_id", "p").collect()), key=str) == sorted(map(tuple, want.select("event_id", "p").collect()), key=str)


def test_pieces_stay_near_the_limit(skewed):
    pieces = cut_large_keys(skewed, ["device_id"], "ts", 40).rows
    sizes = [r["count"] for r in pieces.filter(F.col(PIECE) != WHOLE_KEY).groupBy("device_id", PIECE).count().collect()]
    largest_instant = skewed.groupBy("device_id", "ts").count().agg(F.max("count")).first()[0]
    assert len(sizes) > 8 and max(sizes) <= 2 * 40 + largest_instant
    small = pieces.filter(F.col("device_id") != 1).select(PIECE).distinct().collect()
    assert [r[0] for r in small] == [WHOLE_KEY]


def test_small_keys_are_not_cut(skewed):
    pieces = cut_large_keys(skewed, ["device_id"], "ts")
    assert not pieces.cut and pieces.by == ["device_id"] and "Join" not in pieces.rows._jdf.queryExecution().optimizedPlan().toString()


def test_interval_energy_and_runs(skewed):
    kw = dict(tie=["event_id"], max_gap_seconds=20000, run_ids=True)
    plain = interval_energy(skewed, **kw)
    cut = interval_energy(skewed, piece_rows=30, **kw).select(*plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_gap_report(skewed):
    plain = gap_report(skewed, tie=["event_id"])
    cut = gap_report(skewed, tie=["event_id"], piece_rows=30).select(*plain.columns)
    rows = plain.collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, cut.collect()))


def test_welcome_triggers(skewed):
    history = skewed.select(
        "event_id", F.col("device_id").alias("household"), "ts",
        F.when(F.col("power_w") > 40, "a@gmail.com").otherwise("b@GMAIL.com").alias("email_address"),
    )
    plain = welcome_triggers(history, tie=["event_id"])
    cut = welcome_triggers(history, tie=["event_id"], piece_rows=30).select(*plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_rows_are_shuffled_once(spark, skewed):
    """The handover joins on the partitioning of the window."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = interval_energy(skewed, tie=["event_id"], piece_rows=30)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    left = lines[join + 1 :]
    window = next(i for i, line in enumerate(left) if "Window" in line)
    assert not any("Exchange" in line for line in left[:window])
