"""Rolling-origin tests: what every model would have forecast at many origins, in one plan.

An origin knows the rows up to its slot. Fits at all origins are running sums over a key's hourly rows, so no model is
fitted in a loop; origins are then exploded over the horizons and joined with what came. Series must be dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger.functions.times import add_hours, local_hour

MODELS = ["naive", "profile", "trend", "ar1"]


def _line(n: Column, x: Column, y: Column, xx: Column, xy: Column) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line of n points from their sums; null where there is none."""
    slope = F.try_divide(n * xy - x * y, n * xx - x * x)
    return slope, (y - slope * x) / n


def rolling_origins(
    series: DataFrame, keys: list[str], horizon: int = 24, every: int = 24, history: int = 72, season: int = 24,
    models: list[str] | None = None, tz: str = "UTC", slot: str = "slot_ts", value: str = "kwh",
) -> DataFrame:
    """keys, model, origin, horizon, slot, actual_kwh, forecast_kwh for every ``every``-th slot of a key from its
    ``history``-th on, and 1 to ``horizon`` (at most a season) hours ahead, where a value came.

    naive: the value a season before the slot. profile: the mean of the slot's hour of day up to the origin. trend: the
    least-squares line through all rows up to the origin. ar1: first-order autoregression of the seasonal difference,
    fitted up to the origin. A forecast is null where the rows do not give one.
    """
    if horizon > season:
        raise ValueError("horizon must not exceed the season")
    models = models or MODELS
    y = F.col(value).cast("double")
    rows = series.select(*keys, F.col(slot).alias("_slot"), y.alias("_y"))
    by_key = Window.partitionBy(*keys).orderBy("_slot")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "_i": (F.row_number().over(by_key) - 1).cast("double"),
        "_d": F.col("_y") - F.lag("_y", season).over(by_key),
        "_hour": local_hour(F.col("_slot"), tz),
    }).withColumn("_d1", F.lag("_d").over(by_key))
    # the same hour of earlier days: known at every origin up to a season before the slot
    same_hour = Window.partitionBy(*keys, "_hour").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_before": F.lag("_y", season).over(by_key), "_profile": F.avg("_y").over(same_hour)})
    total = lambda c: F.sum(c).over(so_far)
    pair = F.col("_d").isNotNull() & F.col("_d1").isNotNull()
    paired = lambda c: total(F.when(pair, c))
    fits = rows.withColumns({
        "_n": total(F.lit(1.0)), "_sx": total(F.col("_i")), "_sy": total(F.col("_y")), "_sxx": total(F.col("_i") * F.col("_i")),
        "_sxy": total(F.col("_i") * F.col("_y")), "_pn": paired(F.lit(1.0)), "_px": paired(F.col("_d1")), "_py": paired(F.col("_d")),
        "_pxx": paired(F.col("_d1") * F.col("_d1")), "_pxy": paired(F.col("_d1") * F.col("_d")),
    })
    slope, base = _line(*(F.col(c) for c in ("_n", "_sx", "_sy", "_sxx", "_sxy")))
    phi, c = _line(*(F.col(c) for c in ("_pn", "_px", "_py", "_pxx", "_pxy")))
    index = F.col("_i")
    origins = fits.where((index >= history - 1) & ((index - (history - 1)) % every == 0)).select(
        *keys, F.col("_slot").alias("origin"), index.alias("_at"), slope.alias("_slope"), base.alias("_base"),
        phi.alias("_phi"), c.alias("_c"), F.col("_d").alias("_last_d"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon"),
    )
    came = rows.select(*keys, F.col("_slot").alias(slot), F.col("_y").alias("actual_kwh"), "_before", "_profile")
    met = origins.withColumn(slot, add_hours(F.col("origin"), F.col("horizon"))).join(came, [*keys, slot])
    h, power = F.col("horizon"), F.pow(F.col("_phi"), F.col("horizon").cast("double"))
    drift = F.when(F.col("_phi") == 1.0, F.col("_c") * h).otherwise(F.col("_c") * (F.lit(1.0) - power) / (F.lit(1.0) - F.col("_phi")))
    forecasts = {
        "naive": F.col("_before"),
        "profile": F.col("_profile"),
        "trend": F.col("_base") + F.col("_slope") * (F.col("_at") + h),
        "ar1": F.col("_before") + drift + power * F.col("_last_d"),
    }
    chosen = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), forecasts[m].alias("forecast_kwh")) for m in models])).alias("_f")
    return met.select(*keys, "origin", "horizon", slot, "actual_kwh", chosen).select(
        *keys, F.col("_f")["model"].alias("model"), "origin", "horizon", slot, "actual_kwh", F.col("_f")["forecast_kwh"].alias("forecast_kwh")
    )


def errors_by_horizon(tested: DataFrame, keys: list[str]) -> DataFrame:
    """n, mae, rmse and bias of every model and horizon."""
    r = F.col("actual_kwh") - F.col("forecast_kwh")
    return tested.groupBy(*keys, "model", "horizon").agg(
        F.count(r).alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(r).alias("bias")
    )
