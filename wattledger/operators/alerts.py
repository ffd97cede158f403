"""Alerts: gate, cooldown, notices, mails, address rules and request checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.constants import (
    APPROACHING_MESSAGE,
    COOLDOWN_HOURS,
    CRITICAL_MESSAGE,
    MAIL_CLOSING,
    MAIL_DOMAIN,
    MAIL_LEAD,
    MAIL_SENT,
    MAIL_SUBJECT,
    NOTICE_TIME,
    NOTICES,
    WELCOME_LEAD,
    WELCOME_SUBJECT,
)
from wattledger.functions.text import is_mail_domain, whole_money
from wattledger.operators.budget import mail_color, mail_status
from wattledger.operators.ordered import (
    PIECE,
    PIECE_ROWS,
    WHOLE_KEY,
    Pieces,
    cut_large_keys,
    with_previous,
)
from wattledger.schemas import THRESHOLD_REQUEST
from wattledger.session import shared_dir

WEEK_SECONDS = 7 * 24 * 3600


def alerts_enabled(df: DataFrame, enabled: str = "email_enabled", address: str = "email_address") -> DataFrame:
    """Households that get mails and notices: switched on and with an address."""
    return df.filter(F.col(enabled) & (F.length(address) > 0))


# --- cooldown ------------------------------------------------------------------------------------
#
# An alert is sent if its type differs from the last sent one or the last sent one is more than the
# cooldown old. Since a change of type is always sent, the last sent type equals the type of the
# previous alert; only the time of the last sent one has to be followed through a run of equal types.


def alert_cooldown(
    df: DataFrame, key: str = "household", ts: str = "ts", alert_type: str = "alert_type",
    tie: list[str] | None = None, cooldown_hours: float = COOLDOWN_HOURS,
    piece_rows: int = PIECE_ROWS, piece_seconds: int = WEEK_SECONDS,
) -> DataFrame:
    """Add ``is_sent`` to the alerts; rows without an alert are dropped and change nothing.

    Rows are sorted by household and time and read as a stream of Arrow batches with constant state.
    A household above ``piece_rows`` is cut into time pieces. Each piece first reports, in parallel,
    where its chain of sent alerts ends for every possible start; neighbouring reports are composed, in as many rounds
    as the logarithm of the pieces, to the state at the start of each piece, and all pieces are then marked in parallel.
    """
    tie = tie or []
    cooldown = int(cooldown_hours * 3_600_000_000)
    us = F.coalesce(F.unix_micros(ts), F.lit(0))  # an alert without a time comes first
    alerts = df.filter(F.col(alert_type).isNotNull()).withColumn("_us", us)
    pieces = cut_large_keys(alerts, [key], ts, piece_rows, piece_seconds)
    rows = pieces.rows.withColumn("_real", F.lit(True))
    if pieces.cut:
        starts = _piece_starts(pieces, alert_type, tie, cooldown).withColumn("_real", F.lit(False))
        rows = rows.unionByName(starts, allowMissingColumns=True)
    schema = T.StructType([*rows.schema.fields, T.StructField("is_sent", T.BooleanType())])
    # A hash of the columns, as Spark leaves out a repartitioning by columns that the input already has;
    # an adaptive plan could then read the rows of a household in several tasks.
    marked = (
        rows.repartition(F.xxhash64(*pieces.by))
        .sortWithinPartitions(*pieces.by, "_us", *tie)
        .mapInArrow(_marker(pieces.by, alert_type, cooldown), schema)
        .filter("_real")
    )
    return pieces.with_rows(marked).result().drop("_us", "_real")


def _marker(by: list[str], alert_type: str, cooldown: int):
    never = np.iinfo(np.int64).min

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (household and piece, type, last sent time) of the row before the batch
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            group = lambda row: tuple(batch.column(name)[row].as_py() for name in by)
            kind, us = column(alert_type), column("_us")

            # Runs of one type within a household. Codes are compared, so that a null equals itself.
            new_run = np.zeros(len(us), dtype=bool)
            new_run[0] = True
            for name in (*by, alert_type):
                codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new_run[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new_run)
            ends = np.append(starts[1:], len(us))
            run = np.cumsum(new_run) - 1

            # The first row of a run is sent, unless the run goes on from the batch before.
            inherited = np.full(len(starts), never)
            if before and before[:2] == (group(0), kind[0]):
                inherited[0] = before[2]

            # Put the runs one after another on one line, far enough apart for a single search.
            since_start = us - us[starts][run]
            lengths = since_start[ends - 1]
            offset = np.concatenate(([0], np.cumsum(lengths + cooldown + 1)[:-1]))
            line = since_start + offset[run]
            wait = np.where(inherited > never, inherited + cooldown - us[starts], -1)
            at = np.searchsorted(line, offset + np.maximum(wait, -1), side="right")
            at = at[at < ends]
            sent = np.zeros(len(us), dtype=bool)
            while len(at):
                sent[at] = True
                following = np.searchsorted(line, line[at] + cooldown, side="right")
                at = following[following < ends[run[at]]]

            last = np.flatnonzero(sent[starts[-1]:])
            last_sent = us[starts[-1] + last[-1]] if len(last) else inherited[-1]
            before = (group(len(us) - 1), kind[-1], last_sent)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sent)], names=[*batch.schema.names, "is_sent"]
            )

    return mark


# What a stretch of a household's alerts does to the last sent one before it: the time of the last sent alert after the
# stretch as a step function of the time before it. Stretches that change type end the same way whatever came before.


@dataclass(frozen=True)
class _Report:
    """Steps: a start whose cooldown ends before ``froms[i]``, and not before ``froms[i - 1]``, ends in ``ends[i]``; a start
    beyond all steps stays. Without steps the end is ``fresh``, whatever the start; ``fresh`` is also the end after another
    type or none."""

    first_us: int
    first_type: str
    last_type: str
    froms: np.ndarray
    ends: np.ndarray
    fresh: int

    def end(self, state: tuple[str, int] | None, cooldown: int) -> tuple[str, int]:
        if state is None or state[0] != self.first_type or not len(self.froms):
            return self.last_type, self.fresh
        at = int(np.searchsorted(self.froms, state[1] + cooldown, "right"))
        return self.last_type, int(self.ends[at]) if at < len(self.ends) else state[1]

    def then(self, other: _Report, cooldown: int) -> _Report:
        """Both stretches, one after the other."""
        fresh = other.end((self.last_type, self.fresh), cooldown)[1]
        steps = len(self.froms) and len(other.froms) and self.last_type == other.first_type
        if not steps:  # a type changes between or within them
            none = np.empty(0, np.int64)
            return _Report(self.first_us, self.first_type, other.last_type, none, none, fresh)
        at = np.searchsorted(other.froms, self.ends + cooldown, "right")
        ends = np.where(at < len(other.ends), other.ends[np.minimum(at, len(other.ends) - 1)], self.ends)
        froms, ends = np.concatenate([self.froms, other.froms]), np.concatenate([ends, other.ends])
        # no start reaches further than its cooldown
        reach = int(np.searchsorted(froms, self.first_us + cooldown, "right")) + 1
        return _Report(self.first_us, self.first_type, other.last_type, *_steps(froms[:reach], ends[:reach]), fresh)


def _steps(froms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without steps that lead to the same end as their successor."""
    keep = np.append(ends[1:] != ends[:-1], True)
    return froms[keep], ends[keep]


def _report_of(us: np.ndarray, kind: np.ndarray, cooldown: int) -> _Report:
    """The report of alerts in the order of time."""
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    tail = us[change[-1] :] if len(change) else us
    ends = tail[_chain_ends(tail, cooldown)]
    none = np.empty(0, np.int64)
    if len(change):
        return _Report(int(us[0]), kind[0], kind[-1], none, none, int(ends[0]))
    # A start inside the cooldown before the stretch can only lead to these rows first.
    reach = min(int(np.searchsorted(us, us[0] + cooldown, side="right")) + 1, len(us))
    return _Report(int(us[0]), kind[0], kind[0], *_steps(us[:reach], ends[:reach]), int(ends[0]))


REPORT = [
    T.StructField("first_us", T.LongType()),
    T.StructField("first_type", T.StringType()),
    T.StructField("last_type", T.StringType()),
    T.StructField("froms", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("fresh", T.LongType()),
]
FOLDED = 4  # reports that one task puts together


def _reports(pdf: pd.DataFrame) -> list[_Report]:
    """The reports in the rows, in the order of their numbers."""
    out = []
    for r in pdf.sort_values("_n").itertuples():
        froms, ends = (np.asarray(x if x is not None else [], np.int64) for x in (r.froms, r.ends))
        out.append(_Report(int(r.first_us), r.first_type, r.last_type, froms, ends, int(r.fresh)))
    return out


def _piece_starts(pieces: Pieces, alert_type: str, tie: list[str], cooldown: int) -> DataFrame:
    """The last sent alert before each piece of a cut household, as a row that opens the piece.

    It is older than the rows of the piece. As the first row it counts as sent, which sets the state.
    ``FOLDED`` neighbouring reports are composed to one, round after round, until a household has one; then the states at
    the starts come down the same way. No task holds more than ``FOLDED`` reports, each bounded by the rows of one
    cooldown; rounds are as many as the logarithm of the largest household's pieces, and each is stored.
    """
    rows, by = pieces.rows, pieces.by
    household = by[:-1]
    spark = rows.sparkSession
    target = shared_dir(spark, "cooldown")
    by_fields = [rows.schema[c] for c in by]
    number = T.StructField("_n", T.LongType())

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{target}/{name}")
        return spark.read.schema(df.schema).parquet(f"{target}/{name}")

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_us", *tie], kind="stable")
        found = _report_of(pdf["_us"].to_numpy(), pdf[alert_type].to_numpy(), cooldown)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, **vars(found)}])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        first, *others = _reports(pdf)
        for other in others:
            first = first.then(other, cooldown)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in household}, "_n": pdf["_n"].iloc[0] // FOLDED, **vars(first)}])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        state = None if pd.isna(pdf["_type"].iloc[0]) else (pdf["_type"].iloc[0], int(pdf["_at"].iloc[0]))
        types, times = [], []
        for found in _reports(pdf):
            types.append(state and state[0])
            times.append(state and state[1])
            state = found.end(state, cooldown)
        return pdf[[*household, "_n"]].assign(_type=types, _at=pd.array(times, dtype="Int64"))

    cut = rows.filter(F.col(PIECE) != WHOLE_KEY).select(*by, alert_type, "_us", *tie)
    reports = stored(cut.groupBy(*by).applyInPandas(report, T.StructType([*by_fields, *REPORT])), "pieces")
    # the number of a piece among its household's, from rows without their steps
    numbers = reports.select(*by, (F.row_number().over(Window.partitionBy(*household).orderBy(PIECE)) - 1).cast("bigint").alias("_n"))
    level = stored(reports.join(numbers, by).select(*household, PIECE, "_n", *[f.name for f in REPORT]), "level-0")
    levels, most = [level], level.agg(F.max("_n")).first()[0] or 0  # one number
    schema = T.StructType([*by_fields[:-1], number, *REPORT])
    while most > 0:
        above = levels[-1].drop(PIECE).groupBy(*household, F.expr(f"_n div {FOLDED}").alias("_group")).applyInPandas(composed, schema)
        levels.append(stored(above, f"level-{len(levels)}"))
        most //= FOLDED

    state_schema = T.StructType([*by_fields[:-1], number, T.StructField("_type", T.StringType()), T.StructField("_at", T.LongType())])
    states = levels.pop().select(*household, "_n", F.lit(None).cast("string").alias("_type"), F.lit(None).cast("bigint").alias("_at"))
    while levels:
        above = states.withColumnRenamed("_n", "_group")
        below = levels.pop()
        joined = below.drop(PIECE).withColumn("_group", F.expr(f"_n div {FOLDED}")).join(above, [*household, "_group"])
        states = stored(joined.groupBy(*household, "_group").applyInPandas(starts, state_schema), f"states-{len(levels)}")
    opened = level.select(*household, PIECE, "_n").join(states.where("_type IS NOT NULL"), [*household, "_n"])
    return opened.select(*by, F.col("_type").alias(alert_type), F.col("_at").alias("_us"))


def _chain_ends(us: np.ndarray, cooldown: int) -> np.ndarray:
    """For each row the last one reached by going on to the first row past the cooldown."""
    following = np.searchsorted(us, us + cooldown, side="right")
    jump = np.where(following < len(us), following, np.arange(len(us)))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


# --- notices and mails ---------------------------------------------------------------------------


def notifications(
    df: DataFrame, alert_type: str = "alert_type", cost: str = "next_cost",
    percent: str = "usage_percent", currency: str = "currency",
) -> DataFrame:
    """In-app notices of rows that carry an alert."""
    pick = lambda i: F.when(F.col(alert_type) == "critical", F.lit(NOTICES["critical"][i])).otherwise(
        F.lit(NOTICES["warning"][i])
    )
    message = F.when(
        F.col(alert_type) == "critical",
        F.format_string(CRITICAL_MESSAGE, whole_money(F.col(cost), F.col(currency))),
    ).otherwise(F.format_string(APPROACHING_MESSAGE, F.col(percent).cast("string")))
    return df.filter(F.col(alert_type).isNotNull()).withColumns(
        {
            "id": pick(0),
            "type": pick(1),
            "priority": pick(2),
            "title": pick(3),
            "message": message,
            "time": F.lit(NOTICE_TIME),
            "action": pick(4),
        }
    )


def unread_counts(notices: DataFrame, key: str = "household") -> DataFrame:
    return notices.groupBy(key).agg(F.count(F.lit(1)).alias("unread"))


def _plain_number(x: Column) -> Column:
    """Shortest text of an amount with at most two decimals, without an exponent."""
    return F.regexp_replace(x.cast("decimal(38,2)").cast("string"), "0$", "")


def _full_number(x: Column) -> Column:
    """Shortest text that gives the double again, without an exponent up to 10 ** 7."""
    plain = F.regexp_replace(x.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0*$", "$1")
    return F.when(F.abs(x).between(1e-3, 9_999_999.0) | (x == 0), x.cast("double").cast("string")).otherwise(plain)


def threshold_mail(
    df: DataFrame, percent: str = "usage_percent", budget: str = "budget", cost: str = "next_cost",
    brand: str = "ENERGY",
) -> DataFrame:
    """Texts of the threshold mail; ``brand`` is the word in the subject. Nothing is delivered."""
    p = F.col(percent)
    return df.withColumns(
        {
            "subject": F.format_string(MAIL_SUBJECT, F.lit(brand), p.cast("string")),
            "status_text": mail_status(p),
            "status_color": mail_color(p),
            "lead": F.format_string(MAIL_LEAD, p.cast("string")),
            "budget_line": F.concat(F.lit("Set Budget: ₱"), _full_number(F.col(budget))),
            "cost_line": F.concat(F.lit("Forecasted Cost: ₱"), _plain_number(F.round(F.col(cost), 2))),
            "closing": F.lit(MAIL_CLOSING),
        }
    )


def welcome_mail(df: DataFrame, brand: str = "the") -> DataFrame:
    """Texts of the welcome mail; ``brand`` is the name in the subject."""
    return df.withColumns({"subject": F.lit(WELCOME_SUBJECT % brand), "lead": F.lit(WELCOME_LEAD)})


def outbox_rows(df: DataFrame, address: str = "email_address", error: str | None = None) -> DataFrame:
    """Result status of each mail handed over; ``error`` names a column with a failure text."""
    failure = F.lit(None).cast("string") if error is None else F.col(error)
    return df.withColumns(
        {
            "status": F.when(failure.isNull(), F.lit("success")).otherwise(F.lit("error")),
            "status_message": F.coalesce(failure, F.concat(F.lit(MAIL_SENT), F.col(address))),
        }
    )


# --- settings rules ------------------------------------------------------------------------------


def welcome_triggers(
    history: DataFrame, key: str = "household", ts: str = "ts", address: str = "email_address",
    tie: list[str] | None = None, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Saved settings whose address changed and ends with the mail domain, upper case not accepted.

    Before the first save the address is empty.
    """
    order = [ts, *(tie or [])]
    pieces = with_previous(
        cut_large_keys(history, [key], ts, piece_rows), order, {"previous_address": address}
    )
    changed = F.col(address) != F.coalesce("previous_address", F.lit(""))
    return pieces.result().filter(changed & is_mail_domain(F.col(address), MAIL_DOMAIN, False))


def with_auto_enable(df: DataFrame, address: str = "email_address") -> DataFrame:
    """A valid address, whatever its case, switches the mails on."""
    return df.withColumn(
        "email_enabled", F.coalesce(is_mail_domain(F.col(address), MAIL_DOMAIN, True), F.lit(False))
    )


def clamp_thresholds(low: Column, high: Column, moved: str) -> Column:
    """Pair of thresholds after the 'low' or 'high' one was moved: one point apart, within 0-120."""
    low = F.least(F.greatest(low, F.lit(0)), F.lit(119))
    high = F.least(F.greatest(high, F.lit(1)), F.lit(120))
    if moved == "low":
        low = F.least(low, high - 1)
    else:
        high = F.greatest(high, low + 1)
    return F.struct(low.alias("approaching"), high.alias("critical"))


# --- request checks ------------------------------------------------------------------------------


def parse_threshold_requests(df: DataFrame, body: str = "body", non_negative: bool = False) -> DataFrame:
    """Typed request columns and ``is_valid``; split on it for the quarantine.

    A whole-number percent may come as text or as 85.0, not as 85.5. ``non_negative`` adds the
    documented rule that amounts are not below zero.
    """
    parsed = df.withColumn("_r", F.from_json(body, THRESHOLD_REQUEST))
    percent = F.when(
        F.regexp_like(F.col("_r.usage_percent"), F.lit(r"^\s*[+-]?\d+(\.0*)?\s*$")),
        F.col("_r.usage_percent").try_cast("double").try_cast("bigint"),
    )
    budget, cost = F.col("_r.budget").try_cast("double"), F.col("_r.cost").try_cast("double")
    valid = (
        _text_address(body) & F.col("_r.email").isNotNull() & percent.isNotNull() & budget.isNotNull() & cost.isNotNull()
    )
    if non_negative:
        valid = valid & (percent >= 0) & (budget >= 0) & (cost >= 0)
    return parsed.withColumns(
        {
            "email": F.col("_r.email"),
            "usage_percent": percent,
            "budget": budget,
            "cost": cost,
            "is_valid": F.coalesce(valid, F.lit(False)),
        }
    ).drop("_r")


def _text_address(body: str) -> Column:
    """Whether the body is JSON whose own ``email`` field is a text."""
    field = F.try_variant_get(F.try_parse_json(body), "$.email", "variant")
    return F.coalesce(F.schema_of_variant(field) == "STRING", F.lit(False))


def parse_welcome_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Address and ``is_valid`` of welcome requests."""
    address = F.get_json_object(body, "$.email")
    return df.withColumns({"email": address, "is_valid": _text_address(body) & address.isNotNull()})
