"""Totals, costs, what-if scenarios, ranking, comparison and KPI rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger.constants import (
    CHART_METRICS,
    CHART_SIDES,
    LOAD_MAX,
    LOAD_MIN,
    LOAD_STEP,
    TARIFF_MAX,
    TARIFF_MIN,
    TARIFF_STEP,
    TOP_PRIORITY,
)
from wattledger.functions.numbers import total_or_zero
from wattledger.functions.text import ordinal_label
from wattledger.functions.times import period_index


def period_totals(
    df: DataFrame, keys: list[str], hours: int, ts: str = "ts", kwh: str = "kwh", tz: str = "UTC"
) -> DataFrame:
    """For every period a key touches: energy of the period before (prev) and of the period (next).

    Periods, such as days, follow the clock of the time zone ``tz``.

    Readings are combined per key and period before the first shuffle. Only those sums are then handed
    to their own period and to the following one.
    """
    sums = df.groupBy(*keys, period_index(F.col(ts), hours, tz).alias("period")).agg(F.sum(kwh).alias("_kwh"))
    return prev_next(sums, keys)


def prev_next(sums: DataFrame, keys: list[str], period: str = "period", kwh: str = "_kwh") -> DataFrame:
    """Pair each period's total with the one before it; a missing side is zero."""
    zero = F.lit(0).cast(sums.schema[kwh].dataType)
    roles = F.array(
        F.struct(F.col(period).alias("p"), zero.alias("prev"), F.col(kwh).alias("next")),
        F.struct((F.col(period) + 1).alias("p"), F.col(kwh).alias("prev"), zero.alias("next")),
    )
    return (
        sums.select(*keys, F.explode(roles).alias("_r"))
        .groupBy(*keys, F.col("_r.p").alias(period))
        .agg(
            total_or_zero(F.col("_r.prev")).alias("prev_kwh"),
            total_or_zero(F.col("_r.next")).alias("next_kwh"),
        )
    )


def segment_totals(
    df: DataFrame, keys: list[str], segment: str = "segment", kwh: str = "kwh"
) -> DataFrame:
    """Past and future totals of an assembled series; missing values count as zero."""
    side = lambda name: total_or_zero(F.when(F.col(segment) == name, F.nanvl(F.col(kwh).cast("double"), F.lit(0.0))))
    return df.groupBy(*keys).agg(side("prev").alias("prev_kwh"), side("next").alias("next_kwh"))


def with_costs(df: DataFrame, tariff: float | str) -> DataFrame:
    """prev_cost and next_cost; the tariff is a number or a column name."""
    price = F.col(tariff) if isinstance(tariff, str) else F.lit(float(tariff))
    return df.withColumns({"prev_cost": F.col("prev_kwh") * price, "next_cost": F.col("next_kwh") * price})


def appliance_costs(
    df: DataFrame, keys: list[str], tariff: float, appliance: str = "appliance", kwh: str = "kwh"
) -> DataFrame:
    """Energy and cost per appliance. A plain sum: an appliance with only nulls stays null."""
    return (
        df.groupBy(*keys, appliance)
        .agg(F.sum(kwh).cast("double").alias("kwh"))
        .withColumn("php", F.col("kwh") * F.lit(float(tariff)))
    )


# --- what-if scenarios ---------------------------------------------------------------------------


def valid_scenario(tariff: Column, load_pct: Column) -> Column:
    """Tariff within 5-30 in steps of .01 and load within -50..50 in steps of 5."""
    hundredths = tariff / F.lit(TARIFF_STEP)
    return F.coalesce(
        tariff.between(TARIFF_MIN, TARIFF_MAX)
        & (F.abs(hundredths - F.round(hundredths)) < 1e-6)
        & load_pct.between(LOAD_MIN, LOAD_MAX)
        & (F.pmod(load_pct, F.lit(LOAD_STEP)) == 0),
        F.lit(False),
    )


def with_scenarios(df: DataFrame, scenarios: Sequence[tuple[str, float, int]]) -> DataFrame:
    """One row per scenario (name, tariff, load percent); the list is part of the plan, not a join."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.lit(float(tariff)).alias("tariff"), F.lit(int(load)).alias("load")
            )
            for name, tariff, load in scenarios
        ]
    )
    return (
        df.withColumn("_s", F.explode(rows))
        .withColumns(
            {"scenario": F.col("_s.name"), "tariff": F.col("_s.tariff"), "load_pct": F.col("_s.load")}
        )
        .drop("_s")
    )


def scenario_grid(
    df: DataFrame, tariff_step: float = TARIFF_STEP, load_step: int = LOAD_STEP
) -> DataFrame:
    """Every tariff and load of the domain for each row of ``df`` (a few totals)."""
    n = round((TARIFF_MAX - TARIFF_MIN) / tariff_step)
    steps = F.sequence(F.lit(0), F.lit(n))
    return (
        df.withColumn("_i", F.explode(steps))
        .withColumn("tariff", F.round(F.lit(TARIFF_MIN) + F.col("_i") * F.lit(tariff_step), 2))
        .withColumn("load_pct", F.explode(F.sequence(F.lit(LOAD_MIN), F.lit(LOAD_MAX), F.lit(load_step))))
        .drop("_i")
    )


def load_factor(load_pct: Column) -> Column:
    return F.lit(1.0) + load_pct / F.lit(100.0)


def scenario_costs(df: DataFrame, base_tariff: float) -> DataFrame:
    """What-if costs of rows with prev_kwh, next_kwh, tariff and load_pct.

    The scenario changes the future only: past cost keeps the base tariff. The total line of a chart
    stays unscaled, so ``next_kwh`` is kept beside ``scaled_next_kwh``.
    """
    scaled = F.col("next_kwh") * load_factor(F.col("load_pct"))
    return df.withColumns(
        {
            "scaled_next_kwh": scaled,
            "prev_cost": F.col("prev_kwh") * F.lit(float(base_tariff)),
            "next_cost": scaled * F.col("tariff"),
        }
    )


# --- ranking -------------------------------------------------------------------------------------


def priority_of(name: Column, priority: Sequence[str]) -> Column:
    """Position in the list; names outside it come last."""
    position = F.array_position(F.array(*[F.lit(p) for p in priority]), name)
    return F.when(position > 0, position).otherwise(F.lit(len(priority) + 1)).cast("int")


def top_appliance(
    name: Column, php: Column, priority: Sequence[str] = tuple(TOP_PRIORITY)
) -> Column:
    """Aggregate: the costliest appliance; ties go to the earlier one in ``priority``."""
    return F.max_by(name, F.struct(php, -priority_of(name, priority)))


def ranking(
    costs: DataFrame, keys: list[str], order: Sequence[str] | None, appliance: str = "appliance",
    php: str = "php",
) -> DataFrame:
    """Rank by cost within a key, ties in the order of ``order`` (then by name), with share and label.

    ``costs`` is already aggregated: a key has one row per appliance.
    """
    tie = [F.col(appliance)] if order is None else [priority_of(F.col(appliance), order), F.col(appliance)]
    by_cost = Window.partitionBy(*keys).orderBy(F.col(php).desc(), *tie)
    total = F.sum(php).over(Window.partitionBy(*keys))
    return costs.withColumns(
        {
            "rank": F.row_number().over(by_cost),
            "share_pct": F.when(total > 0, F.col(php) / total * F.lit(100.0)).otherwise(F.lit(0.0)),
        }
    ).withColumn("rank_label", ordinal_label(F.col("rank")))


def totals_with_grand_total(
    df: DataFrame, keys: list[str], tariff: float, appliance: str = "appliance", kwh: str = "kwh"
) -> DataFrame:
    """Appliance rows plus one total row per key."""
    sums = df.groupBy(*keys, appliance).agg(F.sum(kwh).alias("_kwh"))
    return (
        sums.withColumn("_row", F.explode(F.array(F.lit(0), F.lit(1))))
        .groupBy(
            *keys,
            F.when(F.col("_row") == 0, F.col(appliance)).alias(appliance),
            F.col("_row").alias("is_total"),
        )
        .agg(F.sum("_kwh").cast("double").alias("kwh"))
        .withColumn("php", F.col("kwh") * F.lit(float(tariff)))
    )


def rollup_totals(
    df: DataFrame, appliance: str, amounts: dict[str, str]
) -> DataFrame:
    """Appliance rows plus the grand total of the whole table (``amounts``: new name -> column)."""
    return (
        df.rollup(appliance)
        .agg(
            *[F.sum(column).cast("double").alias(name) for name, column in amounts.items()],
            F.grouping(appliance).cast("int").alias("is_total"),
        )
    )


# --- comparison ----------------------------------------------------------------------------------


def change_pct(prev: Column, next_: Column) -> Column:
    """Change in percent; zero where there was nothing before."""
    return F.when(prev > 0, (next_ - prev) / prev * F.lit(100.0)).otherwise(F.lit(0.0))


def direction(prev: Column, next_: Column) -> Column:
    """'increase' only above zero difference, so an unchanged value reads 'decrease'."""
    return F.when(next_ - prev > 0, F.lit("increase")).otherwise(F.lit("decrease"))


def period_comparison(df: DataFrame, threshold: Column | None = None) -> DataFrame:
    """Changes, direction and size of the trend for rows with prev/next energy and cost."""
    limit = F.lit(None).cast("double") if threshold is None else threshold
    return df.withColumns(
        {
            "energy_change_pct": change_pct(F.col("prev_kwh"), F.col("next_kwh")),
            "cost_change_pct": change_pct(F.col("prev_cost"), F.col("next_cost")),
            "trend": direction(F.col("prev_cost"), F.col("next_cost")),
            "trend_abs_pct": F.round(F.abs(change_pct(F.col("prev_cost"), F.col("next_cost"))), 1),
            "forecast_at_risk": F.coalesce((limit > 0) & (F.col("next_kwh") > limit), F.lit(False)),
        }
    )


def comparison_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """Chart rows: energy and a tenth of the cost, previous and next."""
    tenth = lambda c: F.col(c) / F.lit(10.0)
    cells = F.array(
        *[
            F.struct(F.lit(metric).alias("metric"), F.lit(side).alias("side"), amount.alias("amount"))
            for metric, side, amount in [
                (CHART_METRICS[0], CHART_SIDES[0], F.col("prev_kwh")),
                (CHART_METRICS[0], CHART_SIDES[1], F.col("next_kwh")),
                (CHART_METRICS[1], CHART_SIDES[0], tenth("prev_cost")),
                (CHART_METRICS[1], CHART_SIDES[1], tenth("next_cost")),
            ]
        ]
    )
    return df.select(*keys, F.inline(cells))


# --- summary rows --------------------------------------------------------------------------------


def top_of(amounts: dict[str, Column]) -> Column:
    """Name of the largest amount; ties go to the earlier name, and a missing amount is zero."""
    known = {name: F.coalesce(amount, F.lit(0.0)) for name, amount in amounts.items()}
    largest = F.greatest(*known.values()) if len(known) > 1 else next(iter(known.values()))
    return F.coalesce(*[F.when(amount == largest, F.lit(name)) for name, amount in known.items()])


def kpi_totals(
    df: DataFrame, keys: list[str], hours: int, tariff: float,
    priority: Sequence[str] = tuple(TOP_PRIORITY), appliance: str = "appliance",
    ts: str = "ts", kwh: str = "kwh", constants: dict[str, Column] | None = None,
) -> DataFrame:
    """Period totals, costs and the top appliance of the coming period, one row per key and period.

    The top is chosen among the names in ``priority``, which also breaks ties. ``constants`` adds
    appliances whose use in a period is fixed. Only sums are aggregated, so every step is a hash
    aggregate with partial sums before its shuffle.
    """
    constants = constants or {}
    sums = df.groupBy(*keys, appliance, period_index(F.col(ts), hours).alias("period")).agg(
        F.sum(kwh).alias("_kwh")
    )
    zero = F.lit(0).cast(sums.schema["_kwh"].dataType)
    roles = F.array(
        F.struct(F.col("period").alias("p"), zero.alias("prev"), F.col("_kwh").alias("next")),
        F.struct((F.col("period") + 1).alias("p"), F.col("_kwh").alias("prev"), zero.alias("next")),
    )
    part = lambda i: f"_top{i}"
    totals = (
        sums.select(*keys, appliance, F.explode(roles).alias("_r"))
        .groupBy(*keys, F.col("_r.p").alias("period"))
        .agg(
            total_or_zero(F.col("_r.prev")).alias("prev_kwh"),
            total_or_zero(F.col("_r.next")).alias("next_kwh"),
            *[
                F.sum(F.when(F.col(appliance) == name, F.col("_r.next"))).cast("double").alias(part(i))
                for i, name in enumerate(priority)
            ],
        )
    )
    for fixed in constants.values():
        totals = totals.withColumn("next_kwh", F.col("next_kwh") + fixed)
    php = {
        name: constants.get(name, F.col(part(i))) * F.lit(float(tariff)) for i, name in enumerate(priority)
    }
    return (
        with_costs(totals, tariff)
        .withColumns({"top_appliance": top_of(php), "actual_kwh": F.col("prev_kwh")})
        .drop(*[part(i) for i in range(len(priority))])
    )
