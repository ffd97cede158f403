"""Series assembly: length fitting, source priority, totals, overlays and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger.constants import CONSTANT_KWH, FIXED_SHARES, OTHER_SHARE
from wattledger.functions.times import add_hours


def lookup(key: Column, values: dict[str, float], default: float | None = None) -> Column:
    """Value of a small fixed dictionary as an expression; no join is needed."""
    out = F.lit(default).cast("double")
    for name, value in values.items():
        out = F.when(key == name, F.lit(float(value))).otherwise(out)
    return out


def fit_length(
    df: DataFrame, keys: list[str], slots: int, base: float, increment: float,
    slot: str = "slot", value: str = "kwh", axis: DataFrame | None = None,
) -> DataFrame:
    """Exactly ``slots`` values per key: those of the series are kept, nulls inside it too, and what lies
    beyond its last slot follows the line base + slot * increment.

    ``axis`` is a table of keys, each of which gets a series, an empty one if ``df`` has no row of it; without
    it the keys are those of ``df``. Slots beyond the requested length are dropped before the shuffle, and a
    slot that occurs twice counts once, with its largest value, so a key brings at most ``slots`` values
    together.
    """
    number = F.col(slot).cast("int").alias("_slot")
    inside = F.col(slot).between(0, slots - 1)
    # every key has a row without a slot, so that it stays
    rows = df.select(
        *keys, F.when(inside, number).alias("_slot"), F.when(inside, F.col(value).cast("double")).alias("_value"), F.lit(axis is None).alias("_wanted")
    )
    if axis is not None:
        rows = rows.unionByName(axis.select(*keys, F.lit(True).alias("_wanted")), allowMissingColumns=True)
    points = rows.groupBy(*keys, "_slot").agg(F.max("_value").alias("_value"), F.max("_wanted").alias("_wanted"))
    known = F.when(F.col("_slot").isNotNull(), F.struct("_slot", "_value"))
    return (
        points.groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(known)).alias("_points"), F.max("_slot").alias("_last"), F.max("_wanted").alias("_wanted"))
        .filter("_wanted")
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        .withColumn("is_extended", F.col("slot") > F.coalesce("_last", F.lit(-1)))
        .select(
            *keys,
            "slot",
            F.when(F.col("is_extended"), F.lit(base) + F.col("slot") * F.lit(increment))
            .otherwise(F.try_element_at("_points", F.col("slot")))
            .alias("kwh"),
            "is_extended",
        )
    )


def number_slots(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Slot numbers 0, 1, 2, ... by time within a key, for tables with one row per hour or day."""
    by_key = Window.partitionBy(*keys).orderBy(order_by)
    return df.withColumn("slot", F.row_number().over(by_key) - 1)


def source_priority(
    df: DataFrame,
    sample: str,
    ranges: dict[str, tuple[float, float]],
    appliance: str = "appliance",
    constants: dict[str, float] | None = None,
) -> DataFrame:
    """Value and its source: the sample, else the middle of the appliance's range, else a constant."""
    constants = CONSTANT_KWH if constants is None else constants
    middle = lookup(F.col(appliance), {k: (low + high) / 2 for k, (low, high) in ranges.items()})
    constant = lookup(F.col(appliance), constants)
    known = F.col(sample).cast("double")
    return df.withColumns(
        {
            "kwh": F.coalesce(known, middle, constant),
            "source": F.when(known.isNotNull(), F.lit("sample"))
            .when(middle.isNotNull(), F.lit("range"))
            .when(constant.isNotNull(), F.lit("constant")),
        }
    )


def slot_totals(
    df: DataFrame, keys: list[str], slot: str = "slot_ts", kwh: str = "kwh",
    appliance: str = "appliance", expected: list[str] | None = None,
) -> DataFrame:
    """Sum over appliances per slot. A slot where an appliance is missing is flagged.

    ``n_missing`` counts the ``expected`` appliances without a value at the slot, as the sum skips them;
    without a list it counts the null values.
    """
    if expected is None:
        missing = F.sum(F.col(kwh).isNull().cast("int"))
    else:
        there = [F.max((F.col(kwh).isNotNull() & (F.col(appliance) == name)).cast("int")) for name in expected]
        missing = F.lit(len(expected)).cast("bigint")
        for one in there:
            missing = missing - F.coalesce(one, F.lit(0))
    return df.groupBy(*keys, slot).agg(F.sum(kwh).alias("total_kwh"), missing.alias("n_missing"))


def concat_series(past: DataFrame, future: DataFrame) -> DataFrame:
    """Past values followed by future ones on one axis."""
    return past.withColumn("segment", F.lit("prev")).unionByName(
        future.withColumn("segment", F.lit("next")), allowMissingColumns=True
    )


def overlay(
    actual: DataFrame, forecast: DataFrame, keys: list[str], slot: str = "slot_ts",
    value: str = "kwh",
) -> DataFrame:
    """Actual and forecast on one axis; future slots have no actual value.

    Both sides are stacked and folded by slot: one shuffle, where an outer join would need two sorts.
    """
    empty = F.lit(None).cast("double")
    stacked = actual.select(
        *keys, slot, F.col(value).cast("double").alias("actual_kwh"), empty.alias("forecast_kwh")
    ).unionByName(
        forecast.select(
            *keys, slot, empty.alias("actual_kwh"), F.col(value).cast("double").alias("forecast_kwh")
        )
    )
    return stacked.groupBy(*keys, slot).agg(
        F.max("actual_kwh").alias("actual_kwh"), F.max("forecast_kwh").alias("forecast_kwh")
    )


def disaggregate(
    totals: DataFrame, appliance_kwh: DataFrame, keys: list[str], value: str = "kwh",
    appliance: str = "appliance", weight: str = "app_kwh",
) -> DataFrame:
    """Split each total by the appliances' weights; a zero weight total counts as one, nulls stay."""
    of_key = Window.partitionBy(*keys)
    weight_sum = F.sum(weight).over(of_key).cast("double")
    shares = appliance_kwh.withColumn(
        "share", F.col(weight).cast("double") / F.coalesce(F.nullif(weight_sum, F.lit(0.0)), F.lit(1.0))
    ).select(*keys, appliance, "share")
    return totals.join(shares, keys).withColumn("app_actual_kwh", F.col(value).cast("double") * F.col("share"))


def appliance_overlay(past: DataFrame, future: DataFrame, columns: list[str]) -> DataFrame:
    """Per appliance: past forecast is the disaggregated actual, future forecast its own series.

    ``past`` has ``app_actual_kwh``, ``future`` has ``kwh``; ``columns`` are the shared key and slot.
    """
    left = past.select(
        *columns,
        F.col("app_actual_kwh").alias("actual_kwh"),
        F.col("app_actual_kwh").alias("forecast_kwh"),
    )
    right = future.select(
        *columns, F.lit(None).cast("double").alias("actual_kwh"), F.col("kwh").alias("forecast_kwh")
    )
    return concat_series(left, right)


def fixed_share_breakdown(df: DataFrame, value: str = "kwh") -> DataFrame:
    """One row per constant-share part of a household total (the shares add up to 0.95)."""
    parts = F.array(
        *[F.struct(F.lit(n).alias("part"), F.lit(s).alias("share")) for n, s in FIXED_SHARES.items()]
    )
    return (
        df.withColumn("_p", F.explode(parts))
        .withColumn("part", F.col("_p.part"))
        .withColumn("part_kwh", F.col(value).cast("double") * F.col("_p.share"))
        .drop("_p")
    )


def appliance_filter(df: DataFrame, selected: list[str], value: str = "kwh") -> DataFrame:
    """One row per filter choice: the total for 'All Appliances', else the constant share of the
    selected appliance (unknown names: 5 %)."""
    share = lambda name: 1.0 if name.startswith("All Appliances") else FIXED_SHARES.get(name, OTHER_SHARE)
    choices = F.array(
        *[F.struct(F.lit(n).alias("selected"), F.lit(share(n)).alias("share")) for n in selected]
    )
    return (
        df.withColumn("_c", F.explode(choices))
        .withColumn("selected", F.col("_c.selected"))
        .withColumn("selected_kwh", F.col(value).cast("double") * F.col("_c.share"))
        .drop("_c")
    )


def configured_without_series(
    df: DataFrame, configured: DataFrame, keys: list[str], appliance: str = "appliance"
) -> DataFrame:
    """Configured appliance names that never occur in the readings."""
    seen = df.groupBy(*keys, appliance).agg(F.count(F.lit(1)).alias("_n"))
    return configured.join(seen, [*keys, appliance], "left_anti")


def shift_slots(df: DataFrame, hours: int, slot: str = "slot_ts") -> DataFrame:
    return df.withColumn(slot, add_hours(F.col(slot), hours))
