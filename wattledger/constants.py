"""Defaults, dimension rows, shares and message texts that define the results."""

from __future__ import annotations

# Price, budget and threshold defaults.
DEFAULT_TARIFF = 13.47
DEFAULT_BUDGET = 300.0
THRESHOLD_APPROACHING = 80
THRESHOLD_CRITICAL = 100
COOLDOWN_HOURS = 4

# Settings used where a household has saved none.
DEFAULT_SETTINGS = {
    "email_enabled": False,
    "email_address": "",
    "threshold_approaching": THRESHOLD_APPROACHING,
    "threshold_critical": THRESHOLD_CRITICAL,
    "currency": "PHP",
}

# The forecast periods (hours, key, text) and the chart ranges.
PERIODS = [
    (1, "1hour", "Next 1 Hour"),
    (4, "4hours", "Next 4 Hours"),
    (8, "8hours", "Next 8 Hours"),
    (24, "24hours", "Next 24 Hours"),
]
LOOKBACK_HOURS = [1, 4, 8, 24]
CHART_RANGES = [6, 12, 24]

# The live appliances in display order, and the order that breaks ties for the top one.
APPLIANCES = ["Electric Fan", "Air Conditioner", "Refrigerator"]
TOP_PRIORITY = ["Air Conditioner", "Refrigerator", "Electric Fan"]

# Constant breakdown of a household total; any other appliance gets OTHER_SHARE.
FIXED_SHARES = {
    "Air Conditioner": 0.55,
    "Refrigerator": 0.25,
    "Electric Fan": 0.10,
    "Others": 0.05,
}
OTHER_SHARE = 0.05

# Hourly level used where an appliance has neither a sample nor a range
# (midpoints of .05-.15, 2.2-2.8 and 1.1-1.4 kWh).
CONSTANT_KWH = {"Electric Fan": 0.10, "Air Conditioner": 2.5, "Refrigerator": 1.25}

# Straight line that extends a sample that is too short (base + slot * increment).
ACTUAL_BASE, ACTUAL_INCREMENT = 4.2, 0.15
FORECAST_BASE, FORECAST_INCREMENT = 4.1, 0.15

# What-if domains.
TARIFF_MIN, TARIFF_MAX, TARIFF_STEP = 5.0, 30.0, 0.01
LOAD_MIN, LOAD_MAX, LOAD_STEP = -50, 50, 5

# Labels of the four budget rules.
BADGE_LABELS = {
    "neutral": "No Budget Set",
    "danger": "Budget Exceeded",
    "warning": "Approaching Limit",
    "success": "Efficient Usage",
}

# In-app notices (id, type, priority, title, action) per alert type.
NOTICES = {
    "critical": ("budget-critical", "at-risk", "high", "Budget Exceeded!", "Adjust Budget"),
    "warning": ("budget-approaching", "approaching", "medium", "Approaching Budget Limit", "View Details"),
}
NOTICE_TIME = "Just now"

# Colours and status words of the threshold mail.
MAIL_BELOW = ("Approaching Limit", "#F59E0B")
MAIL_REACHED = ("Budget Exceeded", "#EF4444")
MAIL_DOMAIN = "@gmail.com"

# Texts of notices, mails and mail results.
CRITICAL_MESSAGE = "Your forecasted spend (%s) exceeds your budget limit."
APPROACHING_MESSAGE = "You've reached %s%% of your set energy budget for this period."
MAIL_SUBJECT = "⚠️ %s ALERT: Budget Threshold (%s%%)"
MAIL_LEAD = "Your forecasted energy consumption has reached %s%% of your set budget."
MAIL_CLOSING = "Consider adjusting your appliance usage to stay within your limits."
WELCOME_SUBJECT = "Welcome to %s Energy Dashboard!"
WELCOME_LEAD = "Your email has been successfully registered for automated budget alerts."
MAIL_SENT = "Email sent via OAuth2 to "

# Labels of the comparison chart.
CHART_METRICS = ("Energy (kWh)", "Cost (₱/10)")
CHART_SIDES = ("Previous 24h", "Next 24h")
