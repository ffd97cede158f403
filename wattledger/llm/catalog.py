"""All registered queries of this package."""

from __future__ import annotations

from wattledger.llm import queries  # noqa: F401
from wattledger.llm.registry import QUERIES, SQL_TWINS

__all__ = ["QUERIES", "SQL_TWINS"]
