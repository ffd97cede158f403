"""Meter normalisation: scaling, interval energy, power factor, gaps and hourly energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger.functions.times import HOUR_US, hour_slot, seconds_between
from wattledger.operators.ordered import (
    PIECE_ROWS,
    Pieces,
    cut_large_keys,
    with_previous,
    with_running_sum,
)


def scale_raw(
    df: DataFrame,
    voltage_scale: float = 0.1,
    current_scale: float = 0.01,
    power_scale: float = 0.1,
    energy_scale: float = 0.01,
) -> DataFrame:
    """Physical units from raw integers, by multiplication as the stored logs show.

    The current factor of 0.01 reproduces the logs although it yields power factors near 0.09; a meter
    that counts milliamperes needs ``current_scale=0.001``.
    """
    return df.withColumns(
        {
            "voltage_v": F.col("voltage_raw") * F.lit(voltage_scale),
            "current_a": F.col("current_raw") * F.lit(current_scale),
            "power_w": F.col("power_raw") * F.lit(power_scale),
            "kwh_total": F.col("add_ele_raw") * F.lit(energy_scale),
        }
    )


def power_factor(watts: Column, volts: Column, amps: Column) -> Column:
    """W / (V * A), zero where no apparent power flows."""
    return F.coalesce(F.try_divide(watts, volts * amps), F.lit(0.0))


def with_power_factor(df: DataFrame) -> DataFrame:
    return df.withColumn("pf_est", power_factor(F.col("power_w"), F.col("voltage_v"), F.col("current_a")))


def with_kilowatts(df: DataFrame) -> DataFrame:
    return df.withColumn("power_kw", F.col("power_w") / F.lit(1000.0))


def energy_columns(df: DataFrame) -> DataFrame:
    """Fallback and final energy from interval_seconds, kwh_interval_kwh and power_w.

    The counter step counts if it is positive; a flat or falling counter (a reset) leaves the energy to
    the power of the current reading. A reading without an interval has no energy.
    """
    fallback = F.col("power_w") / F.lit(1000.0) * F.col("interval_seconds") / F.lit(3600.0)
    return df.withColumn("energy_fallback_kwh", fallback).withColumn(
        "energy_final_kwh",
        F.when(F.col("interval_seconds").isNull(), F.lit(None).cast("double"))
        .when(F.col("kwh_interval_kwh") > 0, F.col("kwh_interval_kwh"))
        .otherwise(F.col("energy_fallback_kwh")),
    )


def interval_energy(
    df: DataFrame,
    key: str = "device_id",
    ts: str = "ts",
    tie: list[str] | None = None,
    max_gap_seconds: float | None = None,
    run_ids: bool = False,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Energy between successive readings of a device.

    ``df`` needs ``kwh_total`` and ``power_w``. The first reading of a device starts a run, and so does
    one that follows a gap above ``max_gap_seconds``: it has no interval and no energy. ``tie`` names
    columns that order readings of the same instant. ``run_ids`` numbers the runs of a device.
    """
    order = [ts, *(tie or [])]
    pieces = with_previous(
        cut_large_keys(df, [key], ts, piece_rows), order, {"_prev_ts": ts, "_prev_total": "kwh_total"}
    )
    seconds = seconds_between(F.unix_micros(ts), F.unix_micros("_prev_ts"))
    new_run = seconds.isNull()
    if max_gap_seconds is not None:
        new_run = new_run | (seconds > F.lit(float(max_gap_seconds)))
    rows = (
        pieces.rows.withColumn("_new_run", new_run)
        .withColumn("interval_seconds", F.when(~F.col("_new_run"), seconds))
        .withColumn(
            "kwh_interval_kwh",
            F.when(~F.col("_new_run"), F.round(F.col("kwh_total") - F.col("_prev_total"), 6)),
        )
        .drop("_prev_ts", "_prev_total")
    )
    if run_ids:
        rows = rows.withColumn("_step", F.col("_new_run").cast("int"))
        rows = with_running_sum(pieces.with_rows(rows), order, "_step", "run_id").rows
    return energy_columns(pieces.with_rows(rows).result().drop("_new_run", "_step"))


def reading_intervals(
    df: DataFrame, key: str = "device_id", ts: str = "ts", tie: list[str] | None = None,
    piece_rows: int = PIECE_ROWS,
) -> Pieces:
    """Whole seconds between a reading and the one before it, for readings that name a device (first
    readings are left out)."""
    named = df.filter(F.col(key).isNotNull()).select(key, ts, *(tie or []))
    pieces = with_previous(
        cut_large_keys(named, [key], ts, piece_rows), [ts, *(tie or [])], {"gap_start": ts}
    )
    seconds = F.floor(seconds_between(F.unix_micros(ts), F.unix_micros("gap_start")))
    rows = pieces.rows.filter(F.col("gap_start").isNotNull()).select(
        key, "gap_start", F.col(ts).alias("gap_end"), seconds.alias("seconds"),
        *[c for c in pieces.by if c != key],
    )
    return pieces.with_rows(rows)


def median_cadence(intervals: DataFrame, key: str = "device_id") -> DataFrame:
    """Lower median of the interval per device, exact, from a histogram of whole seconds.

    The window sees one row per distinct length, never the readings themselves.
    """
    counts = intervals.groupBy(key, "seconds").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy(key).orderBy("seconds")
    return (
        counts.withColumn("upto", F.sum("n").over(by_length))
        .withColumn("total", F.sum("n").over(Window.partitionBy(key)))
        .filter(F.col("upto") * 2 >= F.col("total"))
        .groupBy(key)
        .agg(F.min("seconds").alias("cadence_seconds"))
    )


def gap_report(
    df: DataFrame, key: str = "device_id", ts: str = "ts", tie: list[str] | None = None,
    factor: float = 3.0, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Gaps longer than ``factor`` times the usual cadence, with the number of missed slots.

    The cadence is joined on the partitioning that the intervals already have, so they are not
    shuffled again; for cut keys it is first repeated for every piece.
    """
    intervals = reading_intervals(df, key, ts, tie, piece_rows)
    cadence = median_cadence(intervals.rows, key)
    if intervals.cut:
        pieces = intervals.rows.groupBy(key, *intervals.by).agg(F.count(F.lit(1)).alias("_n"))
        cadence = pieces.join(cadence, key).drop(key, "_n")
    usual = F.greatest(F.col("cadence_seconds"), F.lit(1))
    joined = intervals.with_rows(intervals.rows.join(cadence, intervals.by))
    return (
        joined.result()
        .filter(F.col("seconds") > F.lit(factor) * usual)
        .withColumn("missed_slots", F.floor(F.col("seconds") / usual) - 1)
    )


def hourly_energy(
    df: DataFrame, keys: list[str], ts: str = "ts", kwh: str = "kwh"
) -> DataFrame:
    """Energy per key and hour; one shuffle, combined before it."""
    return df.groupBy(*keys, hour_slot(F.col(ts)).alias("slot_ts")).agg(
        F.sum(kwh).alias("kwh"), F.count(F.lit(1)).alias("n_readings")
    )


def dense_hours(hourly: DataFrame, keys: list[str], slot: str = "slot_ts") -> DataFrame:
    """Every hour from a key's first to its last slot; hours without a row get nulls.

    The hours between two rows are produced next to the later row, so the grid needs no join. A key
    has at most one row per hour here, whatever its number of readings. A gap is cut at days first, so that one wrong
    clock makes no array of more than its days.
    """
    by_key = Window.partitionBy(*keys).orderBy(slot)
    others = [c for c in hourly.columns if c not in keys and c != slot]
    us = F.unix_micros(slot)
    first = F.coalesce(F.lag(us).over(by_key) + F.lit(HOUR_US), us)
    return (
        hourly.withColumn("_us", us)
        .withColumn("_first", first)
        .withColumn("_from", F.explode(F.sequence("_first", "_us", F.lit(24 * HOUR_US))))
        .withColumn("_to", F.least(F.col("_us"), F.col("_from") + F.lit(23 * HOUR_US)))
        .withColumn("_at", F.explode(F.sequence("_from", "_to", F.lit(HOUR_US))))
        .select(
            *keys,
            F.timestamp_micros("_at").alias(slot),
            *[F.when(F.col("_at") == F.col("_us"), F.col(c)).alias(c) for c in others],
        )
    )


def fill_gaps(
    hourly: DataFrame, keys: list[str], slot: str = "slot_ts", value: str = "kwh"
) -> DataFrame:
    """Dense hourly grid where a missing hour repeats the last known value."""
    back = (
        Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        dense_hours(hourly.select(*keys, slot, value), keys, slot)
        .withColumn("filled_kwh", F.last(value, ignorenulls=True).over(back))
        .withColumn("is_filled", F.col(value).isNull())
    )
