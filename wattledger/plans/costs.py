"""Queries on totals, costs, scenarios, ranking, comparison, KPI rows and budget rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions.numbers import round_half_up, round_to_cents
from wattledger.functions.text import whole_money
from wattledger.functions.times import iso, period_start
from wattledger.operators.axis import period_text
from wattledger.operators.budget import (
    alert_type,
    badge_label,
    budget_status,
    mail_status,
    over_or_remaining,
    progress_pct,
    status_badge,
    usage_percent,
)
from wattledger.operators.cost import (
    appliance_costs,
    change_pct,
    comparison_long as long_form,
    kpi_totals,
    period_comparison as compare,
    period_totals,
    prev_next,
    ranking,
    rollup_totals,
    scenario_costs as what_if,
    scenario_grid as grid_of,
    totals_with_grand_total,
    valid_scenario,
    with_costs,
    with_scenarios,
)
from wattledger.plans.registry import query
from wattledger.plans.tables import (
    BUDGETS_SQL,
    DAYS_SQL,
    ISO,
    KINDS,
    READINGS_SQL,
    TARIFF,
    budgets,
    readings,
    table,
)


def day_text(period: Column) -> Column:
    return F.date_format(period_start(period, 24), "yyyy-MM-dd")


def day_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Energy and cost of every device and day next to the day before."""
    totals = period_totals(readings(spark, folder), ["device_id"], 24)
    return with_costs(totals, TARIFF).withColumn("base_day", day_text(F.col("period"))).drop("period")


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


RATIO_SQL = "next_cost / nullif(budget, 0)"
BADGE_SQL = f"""CASE WHEN budget = 0 THEN 'neutral' WHEN {RATIO_SQL} >= 1.0 THEN 'danger'
    WHEN {RATIO_SQL} >= CAST(0.8 AS DOUBLE) THEN 'warning' ELSE 'success' END"""
PERCENT_SQL = f"CAST(floor({RATIO_SQL} * 100.0 + 0.5) AS BIGINT)"
ALERT_SQL = f"""CASE WHEN budget = 0 THEN CASE WHEN next_cost > 0 THEN 'critical' END
    WHEN {PERCENT_SQL} >= 100 THEN 'critical' WHEN {PERCENT_SQL} >= 80 THEN 'warning' END"""
CHANGE_SQL = "CASE WHEN prev_kwh > 0 THEN (next_kwh - prev_kwh) / prev_kwh * 100.0 ELSE 0.0 END"


@query(
    f"""WITH {DAYS_SQL}, {BUDGETS_SQL}
SELECT d.device_id, base_day, prev_kwh, next_kwh, ROUND(prev_cost, 4) AS prev_cost, ROUND(next_cost, 4) AS next_cost,
  ROUND({CHANGE_SQL}, 4) AS change_pct, {BADGE_SQL} AS status
FROM d JOIN b ON b.device_id = d.device_id"""
)
def flagship_budget_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Every device and day: energy and cost against the day before and against the budget."""
    days = day_costs(spark, folder).join(budgets(spark, folder), "device_id")
    out = days.withColumns(
        {
            "change_pct": change_pct(F.col("prev_kwh"), F.col("next_kwh")),
            "status": status_badge(F.col("next_cost"), F.col("budget")),
        }
    )
    return rounded(out, ["prev_cost", "next_cost", "change_pct"]).select(
        "device_id", "base_day", "prev_kwh", "next_kwh", "prev_cost", "next_cost", "change_pct", "status"
    )


@query(
    f"""WITH {READINGS_SQL}
SELECT device_id, appliance, CAST(SUM(kwh) AS DOUBLE) AS kwh, ROUND(CAST(SUM(kwh) AS DOUBLE) * CAST(13.47 AS DOUBLE), 4) AS php
FROM r GROUP BY 1, 2"""
)
def appliance_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(appliance_costs(readings(spark, folder), ["device_id"], TARIFF), ["php"])


ORDINAL_SQL = "CASE rank WHEN 1 THEN '1st' WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' ELSE concat(rank, 'th') END"


@query(
    f"""WITH {READINGS_SQL},
a AS (SELECT device_id, appliance, CAST(SUM(kwh) AS DOUBLE) AS kwh, CAST(SUM(kwh) AS DOUBLE) * CAST(13.47 AS DOUBLE) AS php FROM r GROUP BY 1, 2),
o AS (SELECT *, list_position(['view', 'click', 'purchase', 'signup', 'error'], appliance) AS pri, SUM(php) OVER (PARTITION BY device_id) AS total FROM a),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY php DESC, pri) AS INTEGER) AS rank FROM o)
SELECT device_id, appliance, floor(kwh * 100.0 + 0.5) / 100.0 AS kwh, CAST(floor(php + 0.5) AS BIGINT) AS php, rank, {ORDINAL_SQL} AS rank_label,
  ROUND(CASE WHEN total > 0 THEN php / total * 100.0 ELSE 0.0 END, 6) AS share_pct
FROM k"""
)
def appliance_ranking(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ranking(appliance_costs(readings(spark, folder), ["device_id"], TARIFF), ["device_id"], KINDS)
    return ranked.select(
        "device_id", "appliance", round_to_cents(F.col("kwh")).alias("kwh"), round_half_up(F.col("php")).alias("php"),
        "rank", "rank_label", F.round("share_pct", 6).alias("share_pct"),
    )


@query(
    f"""WITH {READINGS_SQL},
a AS (SELECT device_id, appliance, SUM(kwh) AS k, grouping(appliance) AS is_total FROM r GROUP BY GROUPING SETS ((device_id, appliance), (device_id)))
SELECT device_id, appliance, CAST(is_total AS INTEGER) AS is_total, CAST(k AS DOUBLE) AS kwh, ROUND(CAST(k AS DOUBLE) * CAST(13.47 AS DOUBLE), 4) AS php FROM a"""
)
def ranking_with_total(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(totals_with_grand_total(readings(spark, folder), ["device_id"], TARIFF), ["php"])


BRANDS_SQL = """l AS (SELECT p_brand AS brand, year(l_shipdate) AS year, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS x
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _brand_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly sums per part with the part's brand: lines are summed before they are shuffled for the
    join, so that a part with very many lines brings one row per year."""
    sums = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey", F.year("l_shipdate").alias("year"))
        .agg(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"),
        )
    )
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return sums.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("brand", "year", "quantity", "price")


@query(
    f"""WITH {BRANDS_SQL}, a AS (SELECT year, brand, CAST(SUM(x) AS DOUBLE) AS php FROM l GROUP BY 1, 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY php DESC, brand) AS INTEGER) AS rank, SUM(php) OVER (PARTITION BY year) AS total FROM a)
SELECT CAST(year AS INTEGER) AS year, brand, php, rank, {ORDINAL_SQL} AS rank_label, ROUND(CASE WHEN total > 0 THEN php / total * 100.0 ELSE 0.0 END, 6) AS share_pct FROM k"""
)
def brand_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking operator on the larger fact: brands by revenue within a year."""
    totals = _brand_lines(spark, folder).groupBy("year", "brand").agg(F.sum("price").cast("double").alias("php"))
    return rounded(ranking(totals, ["year"], None, appliance="brand"), ["share_pct"], 6).select(
        "year", "brand", "php", "rank", "rank_label", "share_pct"
    )


@query(
    f"""WITH {BRANDS_SQL}
SELECT brand, CAST(SUM(q) AS DOUBLE) AS kwh, CAST(SUM(x) AS DOUBLE) AS php, CAST(grouping(brand) AS INTEGER) AS is_total
FROM l GROUP BY ROLLUP (brand)"""
)
def brand_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rollup_totals(_brand_lines(spark, folder), "brand", {"kwh": "quantity", "php": "price"})


SCENARIOS = [
    ("base", 13.47, 0),
    ("dearer", 18.0, 0),
    ("saving", 13.47, -20),
    ("heat wave", 5.0, 50),
    ("off limits", 31.0, 7),
]


@query(
    f"""WITH {DAYS_SQL}, sc AS (SELECT * FROM (VALUES ('base', CAST(13.47 AS DOUBLE), 0), ('dearer', CAST(18 AS DOUBLE), 0), ('saving', CAST(13.47 AS DOUBLE), -20),
  ('heat wave', CAST(5 AS DOUBLE), 50), ('off limits', CAST(31 AS DOUBLE), 7)) v(scenario, tariff, load_pct))
SELECT device_id, base_day, scenario, ROUND(prev_cost, 4) AS prev_cost, ROUND(next_kwh * (1.0 + load_pct / CAST(100 AS DOUBLE)), 6) AS scaled_next_kwh,
  ROUND(next_kwh * (1.0 + load_pct / CAST(100 AS DOUBLE)) * tariff, 6) AS next_cost,
  tariff BETWEEN 5 AND 30 AND load_pct BETWEEN -50 AND 50 AND load_pct % 5 = 0 AS is_valid
FROM d CROSS JOIN sc"""
)
def scenario_costs(spark: SparkSession, folder: str) -> DataFrame:
    days = period_totals(readings(spark, folder), ["device_id"], 24).withColumn("base_day", day_text(F.col("period")))
    out = what_if(with_scenarios(days, SCENARIOS), TARIFF).withColumn(
        "is_valid", valid_scenario(F.col("tariff"), F.col("load_pct"))
    )
    out = rounded(rounded(out, ["prev_cost"]), ["scaled_next_kwh", "next_cost"], 6)
    return out.select("device_id", "base_day", "scenario", "prev_cost", "scaled_next_kwh", "next_cost", "is_valid")


@query(
    f"""WITH {READINGS_SQL}, t AS (SELECT appliance, CAST(SUM(kwh) AS DOUBLE) AS next_kwh FROM r GROUP BY 1),
g AS (SELECT * FROM (SELECT CAST((500 + unnest(range(0, 2501))) AS DOUBLE) / CAST(100 AS DOUBLE) AS tariff), (SELECT unnest(range(-50, 51, 5)) AS load_pct))
SELECT appliance, tariff, CAST(load_pct AS INTEGER) AS load_pct, ROUND(next_kwh * (1.0 + load_pct / CAST(100 AS DOUBLE)) * tariff, 6) AS next_cost
FROM t CROSS JOIN g"""
)
def scenario_grid(spark: SparkSession, folder: str) -> DataFrame:
    """What-if table of the five appliance totals over tariffs 5-30 and loads -50..50."""
    totals = readings(spark, folder).groupBy("appliance").agg(F.sum("kwh").cast("double").alias("next_kwh"))
    grid = what_if(grid_of(totals.withColumn("prev_kwh", F.lit(0.0))), TARIFF)
    return rounded(grid, ["next_cost"], 6).select("appliance", "tariff", "load_pct", "next_cost")


COST_CHANGE_SQL = "CASE WHEN prev_cost > 0 THEN (next_cost - prev_cost) / prev_cost * 100.0 ELSE 0.0 END"


@query(
    f"""WITH {DAYS_SQL}
SELECT device_id, base_day, ROUND({CHANGE_SQL}, 4) AS energy_change_pct, ROUND({COST_CHANGE_SQL}, 4) AS cost_change_pct,
  CASE WHEN next_cost - prev_cost > 0 THEN 'increase' ELSE 'decrease' END AS trend,
  ROUND(ABS({COST_CHANGE_SQL}), 1) AS trend_abs_pct, next_kwh > 100 AS forecast_at_risk
FROM d"""
)
def period_comparison(spark: SparkSession, folder: str) -> DataFrame:
    out = compare(day_costs(spark, folder), threshold=F.lit(100.0))
    return rounded(out, ["energy_change_pct", "cost_change_pct"]).select(
        "device_id", "base_day", "energy_change_pct", "cost_change_pct", "trend", "trend_abs_pct", "forecast_at_risk"
    )


@query(
    f"""WITH {DAYS_SQL}
SELECT device_id, base_day, 'Energy (kWh)' AS metric, 'Previous 24h' AS side, ROUND(prev_kwh, 6) AS amount FROM d
UNION ALL SELECT device_id, base_day, 'Energy (kWh)', 'Next 24h', ROUND(next_kwh, 6) FROM d
UNION ALL SELECT device_id, base_day, 'Cost (₱/10)', 'Previous 24h', ROUND(prev_cost / 10.0, 6) FROM d
UNION ALL SELECT device_id, base_day, 'Cost (₱/10)', 'Next 24h', ROUND(next_cost / 10.0, 6) FROM d"""
)
def comparison_long(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(long_form(day_costs(spark, folder), ["device_id", "base_day"]), ["amount"], 6)


@query(
    """WITH s AS (SELECT l_returnflag, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS p, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS k FROM lineitem GROUP BY 1, 2),
u AS (SELECT l_returnflag, p, 0 AS prev, k AS next FROM s UNION ALL SELECT l_returnflag, p + 1, k, 0 FROM s),
d AS (SELECT l_returnflag, p, CAST(SUM(prev) AS DOUBLE) AS prev_kwh, CAST(SUM(next) AS DOUBLE) AS next_kwh FROM u GROUP BY 1, 2)
SELECT l_returnflag, p // 12 AS year, p % 12 + 1 AS month, prev_kwh AS prev_amount, next_kwh AS next_amount,
  ROUND(CASE WHEN prev_kwh > 0 THEN (next_kwh - prev_kwh) / prev_kwh * 100.0 ELSE 0.0 END, 4) AS change_pct FROM d"""
)
def monthly_change(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison operator on the larger fact: revenue of each month against the month before."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_shipdate", "l_extendedprice")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("bigint")
    sums = lines.groupBy("l_returnflag", month.alias("period")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("_kwh")
    )
    out = prev_next(sums, ["l_returnflag"])
    return out.select(
        "l_returnflag",
        F.floor(F.col("period") / 12).alias("year"),
        (F.col("period") % 12 + 1).alias("month"),
        F.col("prev_kwh").alias("prev_amount"),
        F.col("next_kwh").alias("next_amount"),
        F.round(change_pct(F.col("prev_kwh"), F.col("next_kwh")), 4).alias("change_pct"),
    )


OVER_SQL = """CASE WHEN budget = 0 THEN NULL WHEN next_cost > budget THEN concat('₱', CAST(floor(next_cost - budget + 0.5) AS BIGINT), ' over budget')
    ELSE concat('₱', CAST(floor(budget - next_cost + 0.5) AS BIGINT), ' remaining') END"""


@query(
    f"""WITH {DAYS_SQL}, {BUDGETS_SQL},
ak AS (SELECT device_id, appliance, strftime(ts, '%Y-%m-%d') AS base_day, SUM(kwh) AS k FROM r GROUP BY 1, 2, 3),
an AS (SELECT d.device_id, d.base_day, q.appliance, COALESCE(CAST(k AS DOUBLE), 0.0) * CAST(13.47 AS DOUBLE) AS php
  FROM d CROSS JOIN (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS appliance) q
  LEFT JOIN ak ON ak.device_id = d.device_id AND ak.base_day = d.base_day AND ak.appliance = q.appliance),
tp AS (SELECT *, row_number() OVER (PARTITION BY device_id, base_day ORDER BY php DESC, list_position(['view', 'click', 'purchase', 'signup', 'error'], appliance)) AS rn FROM an)
SELECT d.device_id, d.base_day, prev_kwh, next_kwh, prev_kwh AS actual_kwh, ROUND(prev_cost, 4) AS prev_cost, ROUND(next_cost, 4) AS next_cost,
  tp.appliance AS top_appliance, CASE WHEN next_cost < budget THEN 'OK' ELSE 'At-Risk' END AS budget_status, 'Next 24 Hours' AS period_text,
  ROUND(CASE WHEN {RATIO_SQL} > 1 THEN 100.0 ELSE {RATIO_SQL} * 100.0 END, 4) AS progress_pct, {OVER_SQL} AS budget_text,
  concat('₱', format('{{:,}}', CAST(floor(next_cost + 0.5) AS BIGINT))) AS forecast_text
FROM d JOIN b ON b.device_id = d.device_id
JOIN tp ON tp.device_id = d.device_id AND rn = 1 AND tp.base_day = d.base_day"""
)
def kpi_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = kpi_totals(readings(spark, folder), ["device_id"], 24, TARIFF, KINDS).join(budgets(spark, folder), "device_id")
    cost, budget = F.col("next_cost"), F.col("budget")
    out = rows.withColumns(
        {
            "base_day": day_text(F.col("period")),
            "budget_status": budget_status(cost, budget),
            "period_text": period_text(F.lit(24)),
            "progress_pct": progress_pct(cost, budget),
            "budget_text": over_or_remaining(cost, budget),
            "forecast_text": whole_money(cost, grouping=True),
        }
    )
    return rounded(out, ["prev_cost", "next_cost", "progress_pct"]).select(
        "device_id", "base_day", "prev_kwh", "next_kwh", "actual_kwh", "prev_cost", "next_cost", "top_appliance",
        "budget_status", "period_text", "progress_pct", "budget_text", "forecast_text",
    )


@query(
    f"""WITH {DAYS_SQL}, {BUDGETS_SQL},
x AS (SELECT d.*, budget, {BADGE_SQL} AS badge, {PERCENT_SQL} AS usage_percent, {ALERT_SQL} AS alert_type FROM d JOIN b ON b.device_id = d.device_id)
SELECT device_id, base_day, badge, CASE badge WHEN 'neutral' THEN 'No Budget Set' WHEN 'danger' THEN 'Budget Exceeded' WHEN 'warning' THEN 'Approaching Limit' ELSE 'Efficient Usage' END AS badge_label,
  CASE WHEN next_cost < budget THEN 'OK' ELSE 'At-Risk' END AS budget_status, usage_percent, alert_type,
  CASE WHEN usage_percent < 100 THEN 'Approaching Limit' WHEN usage_percent >= 100 THEN 'Budget Exceeded' END AS mail_status
FROM x"""
)
def budget_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The four budget rules side by side."""
    days = day_costs(spark, folder).join(budgets(spark, folder), "device_id")
    cost, budget = F.col("next_cost"), F.col("budget")
    badge = status_badge(cost, budget)
    percent = usage_percent(cost, budget)
    return days.select(
        "device_id",
        "base_day",
        badge.alias("badge"),
        badge_label(badge).alias("badge_label"),
        budget_status(cost, budget).alias("budget_status"),
        percent.alias("usage_percent"),
        alert_type(cost, budget).alias("alert_type"),
        mail_status(percent).alias("mail_status"),
    )


@query(
    f"""WITH {READINGS_SQL},
s AS (SELECT device_id, appliance, CAST(floor(epoch(ts) / 14400) AS BIGINT) AS p, SUM(kwh) AS k FROM r
  WHERE appliance IN ('view', 'click', 'purchase') GROUP BY 1, 2, 3),
u AS (SELECT device_id, appliance, p, 0 AS prev, k AS next FROM s UNION ALL SELECT device_id, appliance, p + 1, k, 0 FROM s),
f AS (SELECT device_id, p, CAST(SUM(prev) AS DOUBLE) AS prev_kwh, CAST(SUM(next) AS DOUBLE) + CAST(0.6 AS DOUBLE) AS next_kwh,
    COALESCE(CAST(SUM(next) FILTER (WHERE appliance = 'view') AS DOUBLE), 0.0) AS cool,
    COALESCE(CAST(SUM(next) FILTER (WHERE appliance = 'click') AS DOUBLE), 0.0) AS cold FROM u GROUP BY 1, 2)
SELECT device_id, strftime(make_timestamp(p * 14400000000), {ISO}) AS base, prev_kwh, next_kwh, ROUND(next_kwh * CAST(13.47 AS DOUBLE), 4) AS next_cost,
  CASE WHEN cool >= cold AND cool >= CAST(0.6 AS DOUBLE) THEN 'view' WHEN cold >= CAST(0.6 AS DOUBLE) THEN 'click' ELSE 'signup' END AS top_appliance,
  CASE WHEN next_kwh * CAST(13.47 AS DOUBLE) < 300 THEN 'OK' ELSE 'At-Risk' END AS budget_status, 'Next 4 Hours' AS period_text
FROM f"""
)
def landing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Four-hour summary of four appliances. The fan ('signup') is a constant 0.15 kWh per hour, and the
    washing machine ('purchase') counts in the totals but not for the top appliance."""
    fan = F.lit(4 * 0.15)
    measured = readings(spark, folder).filter(F.col("appliance").isin("view", "click", "purchase"))
    rows = kpi_totals(measured, ["device_id"], 4, TARIFF, constants={"signup": fan}, priority=["view", "click", "signup"])
    return rounded(rows, ["next_cost"]).select(
        "device_id",
        iso(period_start(F.col("period"), 4)).alias("base"),
        "prev_kwh",
        "next_kwh",
        "next_cost",
        "top_appliance",
        budget_status(F.col("next_kwh") * F.lit(TARIFF), F.lit(300.0)).alias("budget_status"),
        period_text(F.lit(4)).alias("period_text"),
    )


@query(
    f"""WITH {READINGS_SQL},
s AS (SELECT device_id, CAST(floor((epoch(ts) + 28800) / 86400) AS BIGINT) AS p, SUM(kwh) AS k FROM r GROUP BY 1, 2),
u AS (SELECT device_id, p, CAST(0 AS DECIMAL(18,2)) AS prev, k AS next FROM s
  UNION ALL SELECT device_id, p + 1, k, CAST(0 AS DECIMAL(18,2)) FROM s)
SELECT device_id, strftime(make_timestamp(p * 86400000000) - INTERVAL 8 HOUR, {ISO}) AS day_start_utc,
  CAST(SUM(prev) AS DOUBLE) AS prev_kwh, CAST(SUM(next) AS DOUBLE) AS next_kwh FROM u GROUP BY device_id, p"""
)
def local_day_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Energy of each day and of the day before on the clock of Manila."""
    days = period_totals(readings(spark, folder), ["device_id"], 24, tz="Asia/Manila")
    return days.select(
        "device_id", iso(period_start(F.col("period"), 24, "Asia/Manila")).alias("day_start_utc"),
        F.col("prev_kwh").cast("double").alias("prev_kwh"), F.col("next_kwh").cast("double").alias("next_kwh"),
    )
