"""Household energy metering, cost, budget and forecast analytics on Spark DataFrames."""

__version__ = "0.1.0"
