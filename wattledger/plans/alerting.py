"""Queries on alerts, notices, mails, requests and the outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions.times import iso
from wattledger.operators.alerts import (
    alert_cooldown as hold_repeats,
    alerts_enabled,
    notifications as notices_of,
    outbox_rows,
    parse_threshold_requests,
    parse_welcome_requests,
    parse_welcome_requests,
    threshold_mail as mail_texts,
    unread_counts as count_unread,
)
from wattledger.operators.budget import alert_type, usage_percent
from wattledger.plans.costs import PERCENT_SQL, day_costs
from wattledger.plans.registry import query
from wattledger.plans.tables import (
    ALERT_EVENTS_SQL,
    BUDGETS_SQL,
    DAYS_SQL,
    ISO,
    LEVEL_SQL,
    SETTINGS_SQL,
    alert_events,
    budgets,
    events,
    level,
    settings_history,
)
from wattledger.session import shared_dir
from wattledger.sources.settings import latest_settings, settings_or_default
from wattledger.sources.sinks import write_alert_outbox

COOLDOWN_SQL = f"""WITH RECURSIVE {ALERT_EVENTS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY household ORDER BY ts, event_id) AS rn FROM a),
f AS (SELECT event_id, household, ts, alert_type, rn, true AS is_sent, ts AS last_ts, alert_type AS last_type FROM o WHERE rn = 1
  UNION ALL
  SELECT o.event_id, o.household, o.ts, o.alert_type, o.rn,
    o.alert_type <> f.last_type OR o.ts > f.last_ts + INTERVAL 4 HOUR,
    CASE WHEN o.alert_type <> f.last_type OR o.ts > f.last_ts + INTERVAL 4 HOUR THEN o.ts ELSE f.last_ts END, o.alert_type
  FROM f JOIN o ON o.household = f.household AND o.rn = f.rn + 1)
SELECT event_id, household, strftime(ts, {ISO}) AS at, alert_type, is_sent FROM f"""


@query(COOLDOWN_SQL)
def alert_cooldown(spark: SparkSession, folder: str) -> DataFrame:
    marked = hold_repeats(alert_events(spark, folder), tie=["event_id"])
    return marked.select("event_id", "household", iso(F.col("ts")).alias("at"), "alert_type", "is_sent")


def _day_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Days of households that raise an alert under their own settings, gated by these settings."""
    saved = latest_settings(settings_history(spark, folder), tie=["event_id"]).drop("ts")
    settings = settings_or_default(budgets(spark, folder).withColumnRenamed("device_id", "household"), saved)
    days = day_costs(spark, folder).withColumnRenamed("device_id", "household")
    cost, budget = F.col("next_cost"), F.col("budget")
    alerts = days.join(alerts_enabled(settings), "household").withColumns(
        {
            "alert_type": alert_type(cost, budget, F.col("threshold_approaching"), F.col("threshold_critical")),
            "usage_percent": usage_percent(cost, budget),
        }
    )
    return alerts.filter(F.col("alert_type").isNotNull())


DAY_ALERTS_SQL = f"""WITH {DAYS_SQL}, {BUDGETS_SQL}, {SETTINGS_SQL},
last AS (SELECT household, arg_max(email_enabled, (ts, event_id)) AS email_enabled, arg_max(email_address, (ts, event_id)) AS email_address,
    arg_max(threshold_approaching, (ts, event_id)) AS lo, arg_max(threshold_critical, (ts, event_id)) AS hi,
    arg_max(currency, (ts, event_id)) AS currency FROM h GROUP BY 1),
x AS (SELECT d.device_id AS household, base_day, next_cost, budget, {PERCENT_SQL} AS p,
    CASE WHEN budget = 0 THEN CASE WHEN next_cost > 0 THEN 'critical' END
      WHEN {PERCENT_SQL} >= hi THEN 'critical' WHEN {PERCENT_SQL} >= lo THEN 'warning' END AS alert_type,
    CASE WHEN currency = 'PHP' THEN '₱' ELSE '$' END AS sym, email_address
  FROM d JOIN b ON b.device_id = d.device_id JOIN last ON last.household = d.device_id WHERE email_enabled AND email_address <> ''),
y AS (SELECT * FROM x WHERE alert_type IS NOT NULL)
"""


@query(
    DAY_ALERTS_SQL
    + """SELECT household, base_day,
  CASE alert_type WHEN 'critical' THEN 'budget-critical' ELSE 'budget-approaching' END AS id,
  CASE alert_type WHEN 'critical' THEN 'at-risk' ELSE 'approaching' END AS type,
  CASE alert_type WHEN 'critical' THEN 'high' ELSE 'medium' END AS priority,
  CASE alert_type WHEN 'critical' THEN 'Budget Exceeded!' ELSE 'Approaching Budget Limit' END AS title,
  CASE alert_type WHEN 'critical' THEN concat('Your forecasted spend (', sym, CAST(floor(next_cost + 0.5) AS BIGINT), ') exceeds your budget limit.')
    ELSE concat('You''ve reached ', p, '% of your set energy budget for this period.') END AS message,
  'Just now' AS time, CASE alert_type WHEN 'critical' THEN 'Adjust Budget' ELSE 'View Details' END AS action
FROM y"""
)
def notifications(spark: SparkSession, folder: str) -> DataFrame:
    return notices_of(_day_alerts(spark, folder)).select(
        "household", "base_day", "id", "type", "priority", "title", "message", "time", "action"
    )


@query(
    DAY_ALERTS_SQL
    + """SELECT household, base_day, concat('⚠️ ENERGY ALERT: Budget Threshold (', p, '%)') AS subject,
  CASE WHEN p < 100 THEN 'Approaching Limit' ELSE 'Budget Exceeded' END AS status_text,
  CASE WHEN p < 100 THEN '#F59E0B' ELSE '#EF4444' END AS status_color,
  concat('Your forecasted energy consumption has reached ', p, '% of your set budget.') AS lead,
  concat('Set Budget: ₱', CAST(CAST(budget AS DOUBLE) AS VARCHAR)) AS budget_line,
  concat('Forecasted Cost: ₱', regexp_replace(CAST(CAST(ROUND(next_cost, 2) AS DECIMAL(38,2)) AS VARCHAR), '0$', '')) AS cost_line,
  'Consider adjusting your appliance usage to stay within your limits.' AS closing
FROM y WHERE p IS NOT NULL"""
)
def threshold_mail(spark: SparkSession, folder: str) -> DataFrame:
    alerts = _day_alerts(spark, folder).filter(F.col("usage_percent").isNotNull())
    return mail_texts(alerts).select(
        "household", "base_day", "subject", "status_text", "status_color", "lead", "budget_line", "cost_line", "closing"
    )


@query(DAY_ALERTS_SQL + "SELECT household, COUNT(*) AS unread FROM y GROUP BY 1")
def unread_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_unread(notices_of(_day_alerts(spark, folder)))


@query(
    DAY_ALERTS_SQL
    + """SELECT household, base_day, alert_type, p AS usage_percent, email_address,
  CASE WHEN p IS NULL THEN 'error' ELSE 'success' END AS status,
  CASE WHEN p IS NULL THEN 'usage_percent is not a number' ELSE concat('Email sent via OAuth2 to ', email_address) END AS status_message
FROM y"""
)
def alert_outbox(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts handed to the mailer, stored and read back. Without a budget the percent is no number, and
    the request fails."""
    failure = F.when(F.col("usage_percent").isNull(), F.lit("usage_percent is not a number"))
    rows = outbox_rows(_day_alerts(spark, folder).withColumn("_failure", failure), error="_failure")
    path = shared_dir(spark, "outbox")
    write_alert_outbox(
        rows.select("household", "base_day", "alert_type", "usage_percent", "email_address", "status", "status_message"), path
    )
    return spark.read.parquet(path)


@query(
    f"""WITH e AS (SELECT event_id, event_type, {LEVEL_SQL} AS k, value FROM events)
SELECT event_id, event_type <> 'error' AND event_type <> 'view' AND event_type <> 'signup' AS is_valid,
  CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE k END AS usage_percent,
  CASE WHEN event_type IN ('error', 'view', 'signup') THEN NULL
    WHEN k >= 100 THEN 'critical' WHEN k >= 80 THEN 'warning' END AS alert_type
FROM e"""
)
def alert_requests_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Mail requests rendered from the events' JSON number, some of them broken, and checked."""
    k = level()
    percent = (
        F.when(F.col("event_type") == "error", F.lit('"abc"'))
        .when(F.col("event_type") == "signup", F.concat(k.cast("string"), F.lit(".5")))
        .when(F.col("event_type") == "purchase", F.concat(k.cast("string"), F.lit(".0")))
        .otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
    )
    cost = F.when(F.col("event_type") == "view", F.lit("")).otherwise(
        F.concat(F.lit(', "cost": '), F.col("value").cast("string"))
    )
    body = F.concat(F.lit('{"email": "a@gmail.com", "usage_percent": '), percent, F.lit(', "budget": 300'), cost, F.lit("}"))
    checked = parse_threshold_requests(events(spark, folder).select("event_id", body.alias("body")))
    kind = F.when(F.col("is_valid"), F.when(F.col("usage_percent") >= 100, "critical").when(F.col("usage_percent") >= 80, "warning"))
    return checked.select("event_id", "is_valid", "usage_percent", kind.alias("alert_type"))


@query(
    """SELECT event_id, event_type IN ('view', 'purchase') AS is_valid,
  CASE event_type WHEN 'view' THEN concat('u', user_id, '@gmail.com') WHEN 'purchase' THEN '' WHEN 'signup' THEN '5'
    ELSE NULL END AS email
FROM events"""
)
def welcome_requests_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Welcome requests rendered from events, some of them broken, and checked: the address is a text of the body itself."""
    kind = F.col("event_type")
    body = (
        F.when(kind == "view", F.concat(F.lit('{"email": "u'), F.col("user_id").cast("string"), F.lit('@gmail.com"}')))
        .when(kind == "purchase", F.lit('{"email": ""}'))
        .when(kind == "signup", F.lit('{"meta": {"email": "x"}, "email": 5}'))
        .when(kind == "click", F.lit('{"meta": {"email": "x"}}'))
        .otherwise(F.lit('{"email": "x"'))
    )
    checked = parse_welcome_requests(events(spark, folder).select("event_id", body.alias("body")))
    return checked.select("event_id", "is_valid", F.when(F.try_parse_json("body").isNotNull(), F.col("email")).alias("email"))
