"""Budget rules. Four of them disagree at the edges and are kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.constants import (
    BADGE_LABELS,
    DEFAULT_BUDGET,
    DEFAULT_TARIFF,
    MAIL_BELOW,
    MAIL_REACHED,
    THRESHOLD_APPROACHING,
    THRESHOLD_CRITICAL,
)
from wattledger.functions.numbers import round_half_up, truthy_or


def _percent(value: Column | int) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def has_budget(budget: Column) -> Column:
    """A budget of zero, null or NaN counts as none."""
    return F.coalesce((budget != 0) & ~F.isnan(budget), F.lit(False))


def usage_ratio(cost: Column, budget: Column) -> Column:
    """cost / budget, null without a budget."""
    return F.when(has_budget(budget), F.try_divide(cost, budget))


def status_badge(
    cost: Column, budget: Column,
    approaching: Column | int = THRESHOLD_APPROACHING, critical: Column | int = THRESHOLD_CRITICAL,
) -> Column:
    """Badge rule on the exact ratio: neutral, success, warning or danger."""
    ratio = usage_ratio(cost, budget)
    return (
        F.when(ratio.isNull(), F.lit("neutral"))
        .when(ratio >= _percent(critical) / F.lit(100.0), F.lit("danger"))
        .when(ratio >= _percent(approaching) / F.lit(100.0), F.lit("warning"))
        .otherwise(F.lit("success"))
    )


def badge_label(status: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in BADGE_LABELS.items():
        label = F.when(status == name, F.lit(text)).otherwise(label)
    return label


def budget_status(cost: Column, budget: Column) -> Column:
    """Two-way rule without thresholds: OK strictly below the budget, else At-Risk."""
    return F.when(cost < F.coalesce(budget, F.lit(0.0)), F.lit("OK")).otherwise(F.lit("At-Risk"))


def usage_percent(cost: Column, budget: Column) -> Column:
    """Whole percent, halves up; null without a budget."""
    return round_half_up(usage_ratio(cost, budget) * F.lit(100.0)).cast("bigint")


def alert_type(
    cost: Column, budget: Column,
    approaching: Column | int = THRESHOLD_APPROACHING, critical: Column | int = THRESHOLD_CRITICAL,
) -> Column:
    """Alert rule on the rounded percent. Without a budget any positive cost is critical."""
    percent = usage_percent(cost, budget)
    return (
        F.when(~has_budget(budget), F.when(cost > 0, F.lit("critical")))
        .when(percent >= _percent(critical), F.lit("critical"))
        .when(percent >= _percent(approaching), F.lit("warning"))
    )


def mail_status(percent: Column) -> Column:
    """Mail rule: the limit of 100 is fixed, whatever the household's thresholds are; null stays null."""
    return F.when(percent < 100, F.lit(MAIL_BELOW[0])).when(percent >= 100, F.lit(MAIL_REACHED[0]))


def mail_color(percent: Column) -> Column:
    return F.when(percent < 100, F.lit(MAIL_BELOW[1])).when(percent >= 100, F.lit(MAIL_REACHED[1]))


def progress_pct(cost: Column, budget: Column) -> Column:
    """Budget progress, at most 100; null without a budget."""
    percent = usage_ratio(cost, budget) * F.lit(100.0)
    return F.when(percent > 100, F.lit(100.0)).otherwise(percent)


def over_or_remaining(cost: Column, budget: Column) -> Column:
    """Rounded distance to the budget as text; null without a budget."""
    amount = lambda x: F.concat(F.lit("₱"), round_half_up(x).cast("bigint").cast("string"))
    return F.when(
        has_budget(budget),
        F.when(cost > budget, F.concat(amount(cost - budget), F.lit(" over budget"))).otherwise(
            F.concat(amount(budget - cost), F.lit(" remaining"))
        ),
    )


def budget_for_hours(budget: Column, period_hours: int, budget_period_hours: int | None = None) -> Column:
    """Budget of a period. By default it is compared as is; with ``budget_period_hours`` (720 for a
    month of 30 days) the share that falls into ``period_hours`` is taken."""
    if budget_period_hours is None:
        return budget
    return budget * F.lit(period_hours / budget_period_hours)


def effective_settings(
    df: DataFrame, tariff: str, budget: str,
    default_tariff: float = DEFAULT_TARIFF, default_budget: float = DEFAULT_BUDGET,
) -> DataFrame:
    """Overrides count only if they are set and not zero."""
    return df.withColumns(
        {
            "effective_tariff": truthy_or(F.col(tariff), F.lit(default_tariff)),
            "effective_budget": truthy_or(F.col(budget), F.lit(default_budget)),
        }
    )
