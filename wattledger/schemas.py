"""Explicit schemas of every input and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Meter log, generation 2: clean CSV with raw integers, scaled values and derived energy.
METER_LOG_V2 = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("switch_1", T.BooleanType()),
        T.StructField("voltage_raw", T.LongType()),
        T.StructField("current_raw", T.LongType()),
        T.StructField("power_raw", T.LongType()),
        T.StructField("add_ele_raw", T.LongType()),
        T.StructField("voltage_v", T.DoubleType()),
        T.StructField("current_a", T.DoubleType()),
        T.StructField("power_w", T.DoubleType()),
        T.StructField("kwh_total", T.DoubleType()),
        T.StructField("interval_seconds", T.DoubleType()),
        T.StructField("kwh_interval_kwh", T.DoubleType()),
        T.StructField("energy_fallback_kwh", T.DoubleType()),
        T.StructField("energy_final_kwh", T.DoubleType()),
        T.StructField("pf_est", T.DoubleType()),
    ]
)

_SERIES = T.ArrayType(T.DoubleType())
_LABELS = T.ArrayType(T.StringType())

# Sample dataset: configuration, appliance ranges and one hourly sample per period.
SAMPLE_DATASET = T.StructType(
    [
        T.StructField(
            "settings",
            T.StructType(
                [
                    T.StructField("defaultTariff", T.DoubleType()),
                    T.StructField("defaultBudget", T.DoubleType()),
                    T.StructField("appliances", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "applianceRanges",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())]),
            ),
        ),
        T.StructField(
            "sampleData",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField(
                            "lookback",
                            T.StructType(
                                [
                                    T.StructField("actual", _SERIES),
                                    T.StructField("forecast", _SERIES),
                                    T.StructField("labels", _LABELS),
                                ]
                            ),
                        ),
                        T.StructField(
                            "forecast",
                            T.StructType(
                                [
                                    T.StructField("ac", _SERIES),
                                    T.StructField("refrigerator", _SERIES),
                                    T.StructField("washingMachine", _SERIES),
                                    T.StructField("electricFan", _SERIES),
                                    T.StructField("labels", _LABELS),
                                ]
                            ),
                        ),
                    ]
                ),
            ),
        ),
        T.StructField("actualBaseValue", T.DoubleType()),
        T.StructField("actualIncrement", T.DoubleType()),
        T.StructField("actualRandomRange", T.DoubleType()),
        T.StructField("forecastBaseValue", T.DoubleType()),
        T.StructField("forecastIncrement", T.DoubleType()),
        T.StructField("forecastRandomRange", T.DoubleType()),
    ]
)

SETTINGS = T.StructType(
    [
        T.StructField("household", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("email_enabled", T.BooleanType()),
        T.StructField("email_address", T.StringType()),
        T.StructField("threshold_approaching", T.IntegerType()),
        T.StructField("threshold_critical", T.IntegerType()),
        T.StructField("currency", T.StringType()),
    ]
)

# The meter-event table used as readings. `ts` is read as an instant so that it can carry a watermark.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# The two request kinds of the mail endpoint.
THRESHOLD_REQUEST = T.StructType(
    [
        T.StructField("email", T.StringType()),
        T.StructField("usage_percent", T.StringType()),
        T.StructField("budget", T.StringType()),
        T.StructField("cost", T.StringType()),
    ]
)
