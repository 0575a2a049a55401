"""The session clock: New York wall time plus six hours, so that a session is one calendar date from 00:00 to 23:00."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SESSION_SECONDS = 23 * 3600
RTH_START, RTH_END = 15 * 3600 + 1800, 22 * 3600


def session_clock(ts_utc: Column) -> Column:
    """UTC wall time (TIMESTAMP_NTZ) on the session clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts_utc) + F.expr("INTERVAL '6' HOUR")


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a wall time; no time zone takes part."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def epoch_s(ts: Column) -> Column:
    return F.floor(epoch_us(ts) / F.lit(1_000_000)).cast("long")


def from_epoch(n: Column, unit: str) -> Column:
    """The wall time so many units after 1970; no time zone takes part."""
    return F.timestamp_add(unit, n, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def floor_second(ts: Column) -> Column:
    """The wall time without its fraction of a second; no time zone takes part."""
    return F.timestamp_add("MICROSECOND", -F.pmod(epoch_us(ts), F.lit(1_000_000)), ts)


def second_of_day(ts: Column) -> Column:
    return F.pmod(epoch_s(ts), F.lit(86400))


def is_rth(second: Column) -> Column:
    return ((second >= RTH_START) & (second < RTH_END)).cast("int")


def hour(second: Column) -> Column:
    return F.floor(second / 3600).cast("int")


def session_no(second: Column) -> Column:
    return F.floor(second / 28800).cast("int") + 1


def last_closed_session(now_utc: Column) -> Column:
    """The newest session whose 17:00 New York end has passed at a UTC wall time; Saturday and Sunday have none of their own."""
    closed = F.to_date(session_clock(now_utc) - F.expr("INTERVAL '23' HOUR"))
    back = F.when(F.weekday(closed) == 5, 1).when(F.weekday(closed) == 6, 2).otherwise(0)
    return F.date_sub(closed, back)


def is_open(session_date: Column, now_utc: Column) -> Column:
    """Whether a session has not closed at a UTC wall time: its clock day is not 23 hours old."""
    return session_date > F.to_date(session_clock(now_utc) - F.expr("INTERVAL '23' HOUR"))
