"""Alert cooldown against a step-by-step fold in Python."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattledger.operators.alerts import _report_of, alert_cooldown

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "event_id bigint, household bigint, ts timestamp, alert_type string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def fold(rows, hours=4.0):
    state, out = {}, {}
    for event, household, ts, kind in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if kind is None:
            continue
        last = state.get(household)
        sent = last is None or last[0] != kind or ts - last[1] > timedelta(hours=hours)
        if sent:
            state[household] = (kind, ts)
        out[event] = sent
    return out


def marked(df, **kw):
    return {r.event_id: r.is_sent for r in alert_cooldown(df, tie=["event_id"], **kw).collect()}


def test_documented_sequence(spark):
    steps = [(0, "warning"), (1, "warning"), (2, "critical"), (3, "warning"), (7, "warning"), (7.01, "warning"), (8, None), (9, "warning")]
    rows = [(i, 1, START + timedelta(hours=h), kind) for i, (h, kind) in enumerate(steps)]
    assert marked(frame(spark, rows)) == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True, 7: False}


def sample(seed, flips):
    """Household 1 has half the rows in a dense stretch; households 2 and up are sparse."""
    rng = random.Random(seed)
    rows, kind = [], "warning"
    for i in range(1200):
        household = 1 if i % 2 else 2 + rng.randrange(20)
        minutes = rng.randrange(6 * 24 * 60) if household == 1 else rng.randrange(30 * 24 * 60)
        rows.append([i, household, START + timedelta(minutes=minutes, seconds=rng.randrange(60))])
    rows.sort(key=lambda r: r[2])
    for row in rows:
        if rng.random() < flips:
            kind = {"warning": "critical", "critical": "warning"}[kind]
        row.append(None if rng.random() < 0.05 else kind)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("flips", [0.0, 0.004, 0.2])
@pytest.mark.parametrize("piece_rows, piece_seconds", [(10**9, 86400), (60, 86400), (25, 7200), (5, 86400)])
def test_same_as_fold(spark, flips, piece_rows, piece_seconds):
    rows = sample(int(flips * 1000), flips)
    got = marked(frame(spark, rows), piece_rows=piece_rows, piece_seconds=piece_seconds)
    assert got == fold(rows)


def test_state_crosses_arrow_batches(spark):
    rows = sample(3, 0.01)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert marked(frame(spark, rows)) == fold(rows)
        assert marked(frame(spark, rows), piece_rows=50, piece_seconds=86400) == fold(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_text_keys(spark):
    rows = sample(4, 0.01)
    df = frame(spark, rows)
    df = df.withColumn("household", df.household.cast("string"))
    assert marked(df, piece_rows=50) == fold(rows)


@pytest.mark.parametrize("piece_rows", [10**9, 50])
def test_alerts_without_household(spark, piece_rows):
    rows = sample(6, 0.01)
    df = frame(spark, rows)
    df = df.withColumn("household", F.when(df.household != 1, df.household))
    assert marked(df, piece_rows=piece_rows, piece_seconds=86400) == fold(rows)


@pytest.mark.parametrize("piece_rows", [10**9, 50])
def test_households_stay_together(spark, piece_rows):
    """Adaptive plans must not spread a household over tasks, whatever the input's partitioning was."""
    rows = sample(8, 0.01)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        names = frame(spark, [(0, h, START, "x") for h in range(1, 30)]).select("household", F.lit(1).alias("n"))
        df = frame(spark, rows).join(names, "household").drop("n")
        assert marked(df, piece_rows=piece_rows, piece_seconds=86400) == fold(rows)
        assert marked(frame(spark, rows), piece_rows=piece_rows, piece_seconds=86400) == fold(rows)
    finally:
        spark.conf.set(key, "true")


def test_reports_compose(spark):
    """Any two stretches one after the other do what their composed report says, from every start."""
    rng, cooldown = random.Random(8), 100
    for _ in range(300):
        us = np.sort(np.array([rng.randrange(600) for _ in range(rng.randint(2, 30))], np.int64)) + 1000
        kinds = np.array(["a"] * len(us), object)
        for at in range(len(us)):
            if rng.random() < rng.choice([0, 0.1]):
                kinds[at:] = rng.choice(["a", "b"])
        cut = rng.randint(1, len(us) - 1)
        one, two = _report_of(us[:cut], kinds[:cut], cooldown), _report_of(us[cut:], kinds[cut:], cooldown)
        both, whole = one.then(two, cooldown), _report_of(us, kinds, cooldown)
        starts = [None, *((k, int(us[0]) - d) for k in "ab" for d in (0, 1, 40, 99, 100, 101, 5000))]
        for state in starts:
            expected = state
            for t, k in zip(us.tolist(), kinds):
                if expected is None or expected[0] != k or t - expected[1] > cooldown:
                    expected = (k, t)
            assert both.end(state, cooldown) == whole.end(state, cooldown) == expected
        assert len(both.froms) <= int((us <= us[0] + cooldown).sum()) + 1


def test_a_million_alerts_of_one_household(spark):
    """One a second with few changes of type: no task holds the household, and the result is the sequential rule's."""
    n = 1_000_000
    kind = F.when((F.col("id") > 400_000) & (F.col("id") < 400_500), "critical").otherwise("warning")
    rows = spark.range(0, n, 1, 8).select(F.col("id").alias("event_id"), F.lit(1).alias("household"), F.timestamp_seconds("id").alias("ts"), kind.alias("alert_type"))
    got = alert_cooldown(rows, tie=["event_id"], piece_rows=20_000).where("is_sent").select("event_id").collect()
    expected, last = [], None
    for i in range(n):
        k = "critical" if 400_000 < i < 400_500 else "warning"
        if last is None or k != last[0] or i - last[1] > 4 * 3600:
            expected.append(i)
            last = (k, i)
    assert sorted(r.event_id for r in got) == expected
