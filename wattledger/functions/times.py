"""Time helpers on TIMESTAMP columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def add_hours(ts: Column, hours: Column | int) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return ts + F.make_dt_interval(hours=hours.cast("int"))


def add_days(ts: Column, days: Column | int) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return ts + F.make_interval(days=days.cast("int"))


def hour_label(ts: Column, offset_hours: Column | int = 0) -> Column:
    """``MM/dd/yy HH:mm`` of an hour offset; minutes are kept."""
    return F.date_format(add_hours(ts, offset_hours), "MM/dd/yy HH:mm")


def long_date(ts: Column) -> Column:
    """January 5, 2024."""
    return F.date_format(ts, "MMMM d, yyyy")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def seconds_between(later_us: Column, earlier_us: Column) -> Column:
    return (later_us - earlier_us) / F.lit(1_000_000.0)


def local(ts: Column, tz: str | Column | None) -> Column:
    """Microseconds on the clock of ``tz`` (a name, or a column of names); without one, on the session's clock."""
    if tz is None:
        tz = F.current_timezone()
    return F.unix_micros(F.from_utc_timestamp(ts, tz))


def local_hour(ts: Column, tz: str | Column | None) -> Column:
    return F.pmod(F.floor(local(ts, tz) / F.lit(HOUR_US)), F.lit(24)).cast("int")


def local_date(ts: Column, tz: str | Column | None) -> Column:
    return F.date_from_unix_date(F.floor(local(ts, tz) / F.lit(24 * HOUR_US)).cast("int"))


def local_slot(ts: Column, tz: str | Column | None) -> Column:
    """The instant at which the clock of ``tz`` shows the full hour before ``ts``, also where it is off by half an hour."""
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(local(ts, tz), F.lit(HOUR_US)))


def hour_slot(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def period_index(ts: Column, hours: int, tz: str = "UTC") -> Column:
    """Number of the ``hours``-long period since the epoch, on the clock of the time zone ``tz``."""
    local = ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)
    return F.floor(F.unix_seconds(local) / F.lit(3600 * hours)).cast("bigint")


def period_start(index: Column, hours: int, tz: str = "UTC") -> Column:
    start = F.timestamp_seconds(index * F.lit(3600 * hours))
    return start if tz == "UTC" else F.to_utc_timestamp(start, tz)
