"""Streaming alerts: cooldown with state per household."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wattledger.constants import COOLDOWN_HOURS


class _LastSent(StatefulProcessor):
    """Keeps type and time of the last alert sent to a household."""

    def __init__(self, cooldown_us: int, ttl_ms: int | None):
        self.cooldown_us = cooldown_us
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "kind string, us bigint", self.ttl_ms)

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:
        self.last.update((initial["alert_type"].iloc[0], int(initial["us"].iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # One household's alerts of one micro-batch; the source's rate limit bounds them.
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        state = self.last.get()
        kind, us = (state[0], state[1]) if state is not None else (None, None)
        sent = np.zeros(len(pdf), dtype=bool)
        for i, (row_kind, row_us) in enumerate(zip(pdf["alert_type"].tolist(), pdf["us"].tolist())):
            if row_kind != kind or row_us - us > self.cooldown_us:
                sent[i], kind, us = True, row_kind, row_us
        self.last.update((kind, us))
        yield pdf[["event_id", "household", "us", "alert_type"]].assign(is_sent=sent)

    def close(self) -> None:
        pass


def stream_alert_cooldown(
    alerts: DataFrame, ts: str = "ts", cooldown_hours: float = COOLDOWN_HOURS, ttl_ms: int | None = None,
    last_sent: DataFrame | None = None,
) -> DataFrame:
    """Cooldown on a stream of event_id, household, ts and alert_type.

    ``last_sent`` (see ``last_sent_alerts``) starts the state from alerts that were marked in batch.
    With ``ttl_ms`` silent households are forgotten; such a stream needs a running trigger.
    """
    schema = T.StructType(
        [
            alerts.schema["event_id"],
            alerts.schema["household"],
            T.StructField("us", T.LongType()),
            T.StructField("alert_type", T.StringType()),
            T.StructField("is_sent", T.BooleanType()),
        ]
    )
    out = (
        alerts.filter(F.col("alert_type").isNotNull())
        .select("event_id", "household", F.unix_micros(ts).alias("us"), "alert_type")
        .groupBy("household")
        .transformWithStateInPandas(
            statefulProcessor=_LastSent(int(cooldown_hours * 3_600_000_000), ttl_ms),
            outputStructType=schema,
            outputMode="Append",
            timeMode="None" if ttl_ms is None else "ProcessingTime",
            initialState=None if last_sent is None else last_sent.groupBy("household"),
        )
    )
    return out.withColumn(ts, F.timestamp_micros("us")).drop("us")


def last_sent_alerts(marked: DataFrame, ts: str = "ts") -> DataFrame:
    """Type and time of the last sent alert per household, from the batch operator's result."""
    return (
        marked.filter("is_sent")
        .groupBy("household")
        .agg(
            F.max_by("alert_type", F.struct(ts, "event_id")).alias("alert_type"),
            F.coalesce(F.unix_micros(F.max(ts)), F.lit(0)).alias("us"),  # as in alert_cooldown
        )
    )
