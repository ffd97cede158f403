"""Energy and load that span hours: proration over hour edges, runs of continuous load, mergeable quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions.times import HOUR_US
from wattledger.operators.ordered import PIECE_ROWS, cut_large_keys, with_previous, with_running_sum

DAY_US = 24 * HOUR_US
MICRO = 1_000_000  # shares are whole millionths of a kWh


def prorated_hours(
    intervals: DataFrame, keys: list[str], end: str = "ts", seconds: str = "interval_seconds", kwh: str = "energy_final_kwh"
) -> DataFrame:
    """Energy per key and hour, where an interval's energy is shared among the hours that it spans, by its time in each.

    Energy is rounded to millionths of a kWh, and each hour gets the rounded energy up to its end less that up to its
    beginning, so the hours of an interval add up to it exactly. An interval without length counts in the hour of its end,
    as does energy without an interval length of zero or more; rows without energy or time are left out. An interval is
    cut at days first and each part at its hours, so no array has more than a day's hours or an interval's days.
    """
    us = F.unix_micros(end)
    length = F.greatest(F.coalesce(F.round(F.col(seconds) * MICRO).cast("bigint"), F.lit(0)), F.lit(0))
    rows = intervals.where(F.col(kwh).isNotNull() & F.col(end).isNotNull()).select(
        *keys, (us - length).alias("_from"), us.alias("_to"), F.round(F.col(kwh).cast("double") * MICRO).alias("_energy")
    )
    day = lambda at: F.floor(at / F.lit(DAY_US)).cast("bigint")
    hour = lambda at: F.floor(at / F.lit(HOUR_US)).cast("bigint")
    # the end belongs to the part before it, except where the interval has no length
    last = F.when(F.col("_to") > F.col("_from"), F.col("_to") - 1).otherwise(F.col("_to"))
    days = rows.withColumn("_last", last).select("*", F.explode(F.sequence(day(F.col("_from")), day(F.col("_last")))).alias("_day"))
    begin = F.greatest(F.col("_from"), F.col("_day") * F.lit(DAY_US))
    until = F.least(F.col("_last"), (F.col("_day") + 1) * F.lit(DAY_US) - 1)
    hours = days.select("*", F.explode(F.sequence(hour(begin), hour(until))).alias("_hour"))
    length = F.col("_to") - F.col("_from")
    upto = lambda at: F.when(length == 0, F.col("_energy")).otherwise(F.round(F.col("_energy") * ((at - F.col("_from")) / length)))
    through = upto(F.least(F.col("_to"), (F.col("_hour") + 1) * F.lit(HOUR_US)))
    before = F.when(F.col("_hour") * F.lit(HOUR_US) <= F.col("_from"), F.lit(0.0)).otherwise(upto(F.col("_hour") * F.lit(HOUR_US)))
    shares = hours.select(*keys, F.timestamp_micros(F.col("_hour") * F.lit(HOUR_US)).alias("slot_ts"), (through - before).cast("bigint").alias("_share"))
    return shares.groupBy(*keys, "slot_ts").agg((F.sum("_share") / F.lit(float(MICRO))).alias("kwh"), F.count(F.lit(1)).alias("n_parts"))


def continuous_runs(
    rows: DataFrame, keys: list[str], on: Column, step_seconds: float = 3600.0, ts: str = "slot_ts", tie: list[str] | None = None,
    piece_rows: int = PIECE_ROWS, piece_seconds: int = 7 * 24 * 3600,
) -> DataFrame:
    """Runs of rows that are ``on``, each at most ``step_seconds`` after the one before: key, run, first_ts, last_ts, n_rows.

    Gaps and islands: a row opens a run if the on-row before it is too far away or there is none; runs are numbered by the
    sum of openings. Large keys are cut along time, and each piece hands its last row and its number of openings to the
    next, so that a run goes on across a cut. An off-row between two on-rows is a gap only by the time that it takes.
    """
    active = rows.where(on).select(*keys, ts, *(tie or []))
    pieces = cut_large_keys(active, keys, ts, piece_rows, piece_seconds)
    pieces = with_previous(pieces, [ts, *(tie or [])], {"_before": ts})
    gap = F.unix_micros(ts) - F.unix_micros("_before")
    opens = F.coalesce(gap > F.lit(int(step_seconds * MICRO)), F.lit(True)).cast("int")
    pieces = with_running_sum(pieces.with_rows(pieces.rows.withColumn("_opens", opens)), [ts, *(tie or [])], "_opens", "run")
    return pieces.result().groupBy(*keys, "run").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_rows"))


def longest_runs(runs: DataFrame, keys: list[str], step_seconds: float = 3600.0) -> DataFrame:
    """The longest run per key, the earliest of equally long ones, with its hours (its last row lasts one step)."""
    hours = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(float(HOUR_US)) + F.lit(step_seconds / 3600.0)
    best = F.min(F.struct((-hours).alias("h"), "first_ts", "last_ts", "n_rows")).alias("_best")
    rows = runs.groupBy(*keys).agg(best, F.count(F.lit(1)).alias("n_runs"))
    return rows.select(*keys, "n_runs", (-F.col("_best")["h"]).alias("run_hours"), *[F.col("_best")[c].alias(c) for c in ("first_ts", "last_ts", "n_rows")])


# --- mergeable quantiles -------------------------------------------------------------------------

SKETCH_K = 400  # rank error below 1 % with a probability of 99 %


def day_sketches(readings: DataFrame, key: str, value: str, ts: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """One quantile sketch of a value per key and UTC day: a table that is added to day by day, and merged for any span."""
    day = F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(DAY_US)).cast("int")).alias("day")
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k))
    return readings.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).groupBy(key, day).agg(sketch.alias("sketch"), F.count(value).alias("n"))


def merged_quantiles(sketches: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """Quantiles of all values behind the sketches of a key, one column ``q<percent>`` each; readings are not read again."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_sketch"), F.sum("n").alias("n"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("_sketch", F.lit(float(q))).alias(f"q{q * 100:g}") for q in shares])


def exact_ranks(readings: DataFrame, key: str, value: str, limits: DataFrame, column: str) -> DataFrame:
    """Share of a key's values at or below and below the limit in ``column``; what a sketch's quantile is held against."""
    joined = readings.where(F.col(value).isNotNull()).join(limits.select(key, column), key)
    share = lambda condition: F.avg(condition.cast("double"))
    return joined.groupBy(key).agg(share(F.col(value) <= F.col(column)).alias("upto"), share(F.col(value) < F.col(column)).alias("below"))
