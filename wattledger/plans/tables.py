"""Views of the given tables in the roles of readings, budgets, settings and alerts, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions.text import is_mail_domain
from wattledger.schemas import EVENTS

TARIFF = 13.47
CUTOFF = "2024-01-31 00:00:00"  # end of the readings
KINDS = ["view", "click", "purchase", "signup", "error"]  # the five appliances of the readings


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Meter events; the wall-clock times are read as UTC instants."""
    return spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Energy readings per device and appliance with two exact decimals."""
    return events(spark, folder).select(
        F.col("user_id").alias("device_id"),
        F.col("event_type").alias("appliance"),
        "ts",
        F.col("value").cast("decimal(18,2)").alias("kwh"),
    )


READINGS_SQL = """r AS (
  SELECT event_id, user_id AS device_id, event_type AS appliance, ts, CAST(value AS DECIMAL(18,2)) AS kwh
  FROM events)"""


def level(props: str = "props"):
    """The number in the JSON column, 0 to 99."""
    return F.get_json_object(props, "$.k").cast("bigint")


LEVEL_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def counter_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as cumulative meters: the value is the counter, the JSON number the power in watts."""
    return events(spark, folder).select(
        "event_id",
        F.col("user_id").alias("device_id"),
        "ts",
        F.col("value").alias("kwh_total"),
        level().cast("double").alias("power_w"),
    )


COUNTER_SQL = f"""c AS (
  SELECT event_id, user_id AS device_id, ts, value AS kwh_total, CAST({LEVEL_SQL} AS DOUBLE) AS power_w
  FROM events)"""


def raw_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw meter integers."""
    return events(spark, folder).select(
        "event_id",
        F.col("user_id").alias("device_id"),
        "ts",
        (F.lit(2200) + level()).alias("voltage_raw"),
        F.floor("value").alias("current_raw"),
        F.floor(F.col("value") * F.lit(10.0)).alias("power_raw"),
        F.floor(F.col("value") * F.lit(100.0)).alias("add_ele_raw"),
        (F.col("event_id") % 2 == 0).alias("switch_1"),
    )


RAW_SQL = f"""m AS (
  SELECT event_id, user_id AS device_id, ts, 2200 + {LEVEL_SQL} AS voltage_raw,
    CAST(floor(value) AS BIGINT) AS current_raw,
    CAST(floor(value * CAST(10 AS DOUBLE)) AS BIGINT) AS power_raw,
    CAST(floor(value * CAST(100 AS DOUBLE)) AS BIGINT) AS add_ele_raw,
    event_id % 2 = 0 AS switch_1
  FROM events)"""


def budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as households; a balance of zero or less means that no budget is set."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("device_id"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("budget")
    )


BUDGETS_SQL = """b AS (
  SELECT c_custkey AS device_id, greatest(c_acctbal, CAST(0 AS DOUBLE)) AS budget FROM customer)"""


def settings_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a save of its household's settings."""
    who = F.col("user_id").cast("string")
    address = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("h"), who, F.lit("@gmail.com")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("H"), who, F.lit("@GMAIL.COM")))
        .when(F.col("event_type") == "view", F.concat(F.lit("h"), who, F.lit("@mail.org")))
        .when(F.col("event_type") == "error", F.concat(F.lit("x"), who, F.lit("@gmail.com")))
        .otherwise(F.lit(""))
    )
    k = level()
    return events(spark, folder).select(
        "event_id",
        F.col("user_id").alias("household"),
        "ts",
        is_mail_domain(address, "@gmail.com", True).alias("email_enabled"),
        address.alias("email_address"),
        (F.lit(40) + k % 50).cast("int").alias("threshold_approaching"),
        (F.lit(60) + k % 50).cast("int").alias("threshold_critical"),
        F.when(k % 2 == 0, F.lit("PHP")).otherwise(F.lit("USD")).alias("currency"),
    )


SETTINGS_SQL = f"""h AS (
  SELECT *, lower(email_address) LIKE '%@gmail.com' AS email_enabled FROM (
    SELECT event_id, user_id AS household, ts,
      CASE event_type WHEN 'purchase' THEN concat('h', user_id, '@gmail.com')
        WHEN 'signup' THEN concat('H', user_id, '@GMAIL.COM')
        WHEN 'view' THEN concat('h', user_id, '@mail.org')
        WHEN 'error' THEN concat('x', user_id, '@gmail.com') ELSE '' END AS email_address,
      CAST(40 + {LEVEL_SQL} % 50 AS INTEGER) AS threshold_approaching,
      CAST(60 + {LEVEL_SQL} % 50 AS INTEGER) AS threshold_critical,
      CASE WHEN {LEVEL_SQL} % 2 = 0 THEN 'PHP' ELSE 'USD' END AS currency
    FROM events))"""


def alert_events(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of a household: critical from a value of 80, warning from 40, else none."""
    kind = F.when(F.col("value") >= 80, F.lit("critical")).when(F.col("value") >= 40, F.lit("warning"))
    return events(spark, folder).select(
        "event_id", F.col("user_id").alias("household"), "ts", kind.alias("alert_type")
    )


ALERT_EVENTS_SQL = """a AS (
  SELECT event_id, user_id AS household, ts,
    CASE WHEN value >= 80 THEN 'critical' WHEN value >= 40 THEN 'warning' END AS alert_type
  FROM events WHERE value >= 40)"""

# Energy of the day before (prev) and of the day (next) for every device and day.
DAYS_SQL = f"""{READINGS_SQL},
s AS (SELECT device_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS p, SUM(kwh) AS k FROM r GROUP BY 1, 2),
u AS (SELECT device_id, p, CAST(0 AS DECIMAL(18,2)) AS prev, k AS next FROM s
  UNION ALL SELECT device_id, p + 1, k, CAST(0 AS DECIMAL(18,2)) FROM s),
d0 AS (SELECT device_id, p, CAST(SUM(prev) AS DOUBLE) AS prev_kwh, CAST(SUM(next) AS DOUBLE) AS next_kwh
  FROM u GROUP BY 1, 2),
d AS (SELECT device_id, strftime(make_timestamp(p * 86400000000), '%Y-%m-%d') AS base_day, prev_kwh, next_kwh,
    prev_kwh * CAST(13.47 AS DOUBLE) AS prev_cost, next_kwh * CAST(13.47 AS DOUBLE) AS next_cost
  FROM d0)"""

HOURS_SQL = f"""{READINGS_SQL},
hr AS (SELECT device_id, appliance, date_trunc('hour', ts) AS slot_ts, SUM(kwh) AS kwh FROM r GROUP BY 1, 2, 3)"""

DEVICE_HOURS_SQL = f"""{READINGS_SQL},
hr AS (SELECT device_id, date_trunc('hour', ts) AS slot_ts, SUM(kwh) AS kwh FROM r GROUP BY 1, 2)"""

APPLIANCE_HOURS_SQL = f"""{READINGS_SQL},
hr AS (SELECT appliance, date_trunc('hour', ts) AS slot_ts, SUM(kwh) AS kwh FROM r GROUP BY 1, 2)"""

ISO = "'%Y-%m-%d %H:%M:%S'"
