"""All registered queries."""

from __future__ import annotations

from wattledger.plans import alerting, axes, costs, forecasts, metering, models, streams  # noqa: F401
from wattledger.plans.registry import QUERIES, SQL_TWINS

__all__ = ["QUERIES", "SQL_TWINS"]
