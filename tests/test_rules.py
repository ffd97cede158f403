"""Budget, alert, settings and text rules at their edges."""

import pytest
from pyspark.sql import functions as F

from wattledger.functions.numbers import (
    leading_double,
    leading_int,
    or_zero,
    round_half_up,
    round_to_cents,
    truthy_or,
)
from wattledger.functions.text import ordinal_label, whole_money
from wattledger.operators.alerts import (
    alerts_enabled,
    clamp_thresholds,
    notifications,
    outbox_rows,
    parse_threshold_requests,
    parse_welcome_requests,
    threshold_mail,
    unread_counts,
)
from wattledger.operators.axis import build_axis, day_steps, period_key, period_text
from wattledger.operators.budget import (
    alert_type,
    budget_for_hours,
    budget_status,
    mail_status,
    over_or_remaining,
    progress_pct,
    status_badge,
    usage_percent,
)
from wattledger.sources.settings import latest_settings, settings_or_default


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_rounding(spark):
    rows = [(-2.5,), (2.5,), (2.4,), (-2.6,)]
    assert values(spark, rows, "x double", round_half_up(F.col("x"))) == [(-2,), (3,), (2,), (-3,)]
    assert values(spark, [(12.344,), (12.346,)], "x double", round_to_cents(F.col("x"))) == [(12.34,), (12.35,)]
    assert values(spark, [(None,), (float("nan"),), (2.0,)], "x double", or_zero(F.col("x"))) == [(0.0,), (0.0,), (2.0,)]
    assert values(spark, [(None,), (0.0,), (7.0,)], "x double", truthy_or(F.col("x"), F.lit(9.0))) == [(9.0,), (9.0,), (7.0,)]


def test_typed_numbers(spark):
    texts = ["12abc", "", "abc", "-3.5e1x", ".5", " 7 ", "1e", None]
    got = values(spark, [(t,) for t in texts], "x string", leading_double(F.col("x")), leading_int(F.col("x")))
    assert got == [(12.0, 12), (0.0, 0), (0.0, 0), (-35.0, -3), (0.5, 0), (7.0, 7), (1.0, 1), (0.0, 0)]


EDGES = [
    # ratio of the budget: badge, alert
    (0.7949, "success", None),
    (0.795, "success", "warning"),
    (0.80, "warning", "warning"),
    (0.995, "warning", "critical"),
    (1.0, "danger", "critical"),
]


def test_status_edges(spark):
    cost, budget = F.col("c"), F.col("b")
    got = values(spark, [(r * 1000, 1000.0) for r, _, _ in EDGES], "c double, b double", status_badge(cost, budget), alert_type(cost, budget))
    assert got == [(badge, alert) for _, badge, alert in EDGES]


def test_without_budget(spark):
    cost, budget = F.col("c"), F.col("b")
    rows = [(5.0, 0.0), (0.0, 0.0), (5.0, None)]
    got = values(spark, rows, "c double, b double", status_badge(cost, budget), budget_status(cost, budget), alert_type(cost, budget), progress_pct(cost, budget), usage_percent(cost, budget))
    assert got == [
        ("neutral", "At-Risk", "critical", None, None),
        ("neutral", "At-Risk", None, None, None),
        ("neutral", "At-Risk", "critical", None, None),
    ]


def test_own_thresholds_but_fixed_mail_limit(spark):
    cost, budget = F.col("c"), F.col("b")
    got = values(spark, [(60.0, 100.0), (95.0, 100.0)], "c double, b double", status_badge(cost, budget, 50, 90), alert_type(cost, budget, 50, 90), mail_status(usage_percent(cost, budget)))
    assert got == [("warning", "warning", "Approaching Limit"), ("danger", "critical", "Approaching Limit")]


def test_progress_and_remaining(spark):
    cost, budget = F.col("c"), F.col("b")
    got = values(spark, [(150.0, 100.0), (100.0, 100.0), (40.4, 100.0)], "c double, b double", progress_pct(cost, budget), over_or_remaining(cost, budget))
    assert got == [(100.0, "₱50 over budget"), (100.0, "₱0 remaining"), (40.4, "₱60 remaining")]
    assert values(spark, [(720.0,)], "b double", budget_for_hours(F.col("b"), 24), budget_for_hours(F.col("b"), 24, 720)) == [(720.0, 24.0)]


def test_labels(spark):
    got = values(spark, [(i,) for i in (1, 2, 3, 4, 21)], "r int", ordinal_label(F.col("r")))
    assert got == [("1st",), ("2nd",), ("3rd",), ("4th",), ("21th",)]
    got = values(spark, [(1234.5, "PHP"), (9.4, "USD")], "x double, c string", whole_money(F.col("x"), F.col("c")), whole_money(F.col("x"), grouping=True))
    assert got == [("₱1235", "₱1,235"), ("$9", "₱9")]


def test_periods_and_axis(spark):
    got = values(spark, [(h,) for h in (1, 4, 8, 24, 6, None)], "h int", period_key(F.col("h")), period_text(F.col("h")))
    assert [g[0] for g in got] == ["1hour", "4hours", "8hours", "24hours", None, None]
    assert got[0][1] == "Next 1 Hour" and got[4][1] == got[5][1] == "Next 24 Hours"
    base = spark.sql("SELECT timestamp'2024-12-31 22:07:30' AS base")
    axis = build_axis(base, "base", 4, 0).orderBy("offset_h").collect()
    assert [(r.offset_h, r.segment) for r in axis] == [(-1, "prev"), (0, "next"), (1, "next"), (2, "next"), (3, "next")]
    assert [r.label for r in axis] == ["12/31/24 21:07", "12/31/24 22:07", "12/31/24 23:07", "01/01/25 00:07", "01/01/25 01:07"]
    step = day_steps(base, "base").first()
    assert (step.next_date.isoformat(), step.date_label) == ("2025-01-01T22:07:30", "December 31, 2024")


def test_threshold_pair(spark):
    rows = [(80, 100), (100, 80), (-5, 130), (120, 120)]
    got = values(spark, rows, "a int, b int", clamp_thresholds(F.col("a"), F.col("b"), "low"), clamp_thresholds(F.col("a"), F.col("b"), "high"))
    assert [tuple(tuple(x) for x in g) for g in got] == [((80, 100), (80, 100)), ((79, 80), (100, 101)), ((0, 120), (0, 120)), ((119, 120), (119, 120))]


def test_notices_and_mail(spark):
    rows = [(1, "critical", 416.4, 139, "PHP", 300.0), (2, "warning", 250.0, 83, "USD", 300.5), (3, None, 1.0, 0, "PHP", 300.0)]
    df = spark.createDataFrame(rows, "household int, alert_type string, next_cost double, usage_percent int, currency string, budget double")
    notes = {r.household: r for r in notifications(df).collect()}
    assert set(notes) == {1, 2}
    assert notes[1].message == "Your forecasted spend (₱416) exceeds your budget limit." and notes[1].priority == "high"
    assert notes[2].message == "You've reached 83% of your set energy budget for this period." and notes[2].type == "approaching"
    assert {r.unread for r in unread_counts(notifications(df)).collect()} == {1}
    mails = {r.household: r for r in threshold_mail(df).collect()}
    assert mails[1].status_text == "Budget Exceeded" and mails[1].subject.endswith("ALERT: Budget Threshold (139%)")
    assert mails[2].budget_line == "Set Budget: ₱300.5" and mails[1].cost_line == "Forecasted Cost: ₱416.4"


def test_gate_and_outbox(spark):
    df = spark.createDataFrame([(True, "a@gmail.com", None), (True, "", None), (False, "b@gmail.com", None), (True, "c@gmail.com", "no route")], "email_enabled boolean, email_address string, err string")
    sent = outbox_rows(alerts_enabled(df), error="err").orderBy("email_address").collect()
    assert [(r.status, r.status_message) for r in sent] == [("success", "Email sent via OAuth2 to a@gmail.com"), ("error", "no route")]


@pytest.mark.parametrize(
    "body, valid",
    [
        ('{"email": "a@x", "usage_percent": 85, "budget": 300, "cost": 255.5}', True),
        ('{"email": "a@x", "usage_percent": "85", "budget": "300", "cost": 1}', True),
        ('{"email": "a@x", "usage_percent": 85.0, "budget": 300, "cost": 1}', True),
        ('{"email": "a@x", "usage_percent": 85.5, "budget": 300, "cost": 1}', False),
        ('{"email": "a@x", "usage_percent": "x", "budget": 300, "cost": 1}', False),
        ('{"email": "a@x", "usage_percent": 85, "budget": 300}', False),
        ('{"email": 5, "usage_percent": 85, "budget": 300, "cost": 1}', False),
        ('{"usage_percent": 85, "budget": 300, "cost": 1}', False),
        ("not json", False),
    ],
)
def test_threshold_requests(spark, body, valid):
    assert parse_threshold_requests(spark.createDataFrame([(body,)], "body string")).first().is_valid is valid


def test_request_options(spark):
    df = spark.createDataFrame([('{"email": "a@x", "usage_percent": 85, "budget": -1, "cost": 1}',)], "body string")
    assert parse_threshold_requests(df).first().is_valid and not parse_threshold_requests(df, non_negative=True).first().is_valid
    mails = spark.createDataFrame([('{"email": "a@x"}',), ('{"mail": "a@x"}',), ("{}",)], "body string")
    assert [r.is_valid for r in parse_welcome_requests(mails).collect()] == [True, False, False]


def test_settings(spark):
    history = spark.sql(
        """SELECT * FROM VALUES (1L, timestamp'2024-01-01', true, 'a@gmail.com', 70, 90, 'USD'),
        (1L, timestamp'2024-01-02', true, 'b@gmail.com', 60, 95, 'USD') AS t(household, ts, email_enabled, email_address,
        threshold_approaching, threshold_critical, currency)"""
    )
    households = spark.createDataFrame([(1,), (2,)], "household bigint")
    got = {r.household: r for r in settings_or_default(households, latest_settings(history)).collect()}
    assert (got[1].email_address, got[1].threshold_approaching) == ("b@gmail.com", 60)
    assert (got[2].email_enabled, got[2].email_address, got[2].threshold_critical, got[2].currency) == (False, "", 100, "PHP")
