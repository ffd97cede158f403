"""Time axes, day steps, period dimension and lookback windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.constants import CHART_RANGES, LOOKBACK_HOURS, PERIODS
from wattledger.functions.times import add_days, add_hours, hour_label, long_date


def build_axis(
    df: DataFrame, base: str, forecast_hours: int | str, lookback_hours: int | str
) -> DataFrame:
    """Hour offsets around ``base``: -n..-1 (prev) and 0..m-1 (next), each side at least one slot.

    The hour counts are numbers or column names.
    """

    def at_least_one(hours: int | str) -> Column:
        column = F.col(hours) if isinstance(hours, str) else F.lit(hours)
        return F.greatest(F.lit(1), column.cast("int"))

    offsets = F.sequence(-at_least_one(lookback_hours), at_least_one(forecast_hours) - 1)
    return df.withColumn("offset_h", F.explode(offsets)).withColumns(
        {
            "segment": F.when(F.col("offset_h") < 0, F.lit("prev")).otherwise(F.lit("next")),
            "slot_ts": add_hours(F.col(base), F.col("offset_h")),
            "label": hour_label(F.col(base), F.col("offset_h")),
        }
    )


def day_steps(df: DataFrame, base: str) -> DataFrame:
    """The day before and after, time of day kept, with the long date text."""
    return df.withColumns(
        {
            "prev_date": add_days(F.col(base), -1),
            "next_date": add_days(F.col(base), 1),
            "date_label": long_date(F.col(base)),
        }
    )


def period_key(hours: Column) -> Column:
    """1hour, 4hours, 8hours, 24hours; null for any other number of hours."""
    key = F.lit(None).cast("string")
    for value, name, _ in PERIODS:
        key = F.when(hours == value, F.lit(name)).otherwise(key)
    return key


def period_text(hours: Column) -> Column:
    """Text of the period; any other number of hours reads as the longest one."""
    text = F.lit(PERIODS[-1][2])
    for value, _, name in PERIODS[:-1]:
        text = F.when(hours == value, F.lit(name)).otherwise(text)
    return text


def with_period(df: DataFrame, hours: str) -> DataFrame:
    column = F.col(hours)
    return df.withColumns(
        {
            "period_key": period_key(column),
            "period_text": period_text(column),
            "valid_period": F.coalesce(column.isin([p[0] for p in PERIODS]), F.lit(False)),
            "valid_range": F.coalesce(column.isin(CHART_RANGES), F.lit(False)),
        }
    )


def within_range(df: DataFrame, hours: int, offset: str = "offset_h") -> DataFrame:
    """Slots before the chart range of 6, 12 or 24 hours ends."""
    if hours not in CHART_RANGES:
        raise ValueError(f"chart range must be one of {CHART_RANGES}")
    return df.filter(F.col(offset) < hours)


def range_totals(df: DataFrame, keys: list[str], offset: str = "offset_h", kwh: str = "kwh") -> DataFrame:
    """Slots and energy of all chart ranges in one aggregate; a range without a slot has no row."""
    sums = []
    for hours in CHART_RANGES:
        inside = F.col(offset) < hours
        sums.append(F.struct(F.lit(hours).alias("range_h"), F.count_if(inside).alias("slots"), F.sum(F.when(inside, F.col(kwh))).alias("kwh")))
    found = df.filter(F.col(offset) < max(CHART_RANGES)).groupBy(*keys).agg(F.array(*sums).alias("_ranges"))
    return found.select(*keys, F.inline("_ranges")).filter(F.col("slots") > 0)


def lookback_window(df: DataFrame, base: datetime, hours: int, ts: str = "ts") -> DataFrame:
    """Readings of the last ``hours`` before ``base``; the bounds reach the scan."""
    if hours not in LOOKBACK_HOURS:
        raise ValueError(f"lookback must be one of {LOOKBACK_HOURS}")
    end = F.lit(base)
    return df.filter((F.col(ts) >= end - F.make_dt_interval(hours=F.lit(hours))) & (F.col(ts) < end))


def lookback_totals(
    df: DataFrame, base: datetime, keys: list[str], ts: str = "ts", kwh: str = "kwh"
) -> DataFrame:
    """Totals of all four lookback windows in one pass over the longest of them."""
    end = F.lit(base)
    longest = lookback_window(df, base, max(LOOKBACK_HOURS), ts)
    fits = F.filter(
        F.array(*[F.lit(h) for h in LOOKBACK_HOURS]),
        lambda h: F.col(ts) >= end - F.make_dt_interval(hours=h),
    )
    return (
        longest.withColumn("lookback_h", F.explode(fits))
        .groupBy(*keys, "lookback_h")
        .agg(F.sum(kwh).cast("double").alias("kwh"), F.count(F.lit(1)).alias("n_readings"))
    )
