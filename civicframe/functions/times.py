"""Date and time functions (T1-T11). All assume the session zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two input layouts the pages parse.
MDY_HMS = "MM/dd/yyyy hh:mm:ss a"          # 311 files: 03/09/2024 07:27:09 AM
ISO_WITH_OFFSET = "yyyy-MM-dd HH:mm:ss Z"  # health export: 2023-06-01 23:10:44 -0500
DAY_SECONDS = 86400


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_timestamp(col, fmt: str = MDY_HMS) -> Column:
    """Text to timestamp; unparseable text becomes null."""
    return F.try_to_timestamp(_c(col), F.lit(fmt))


def to_zone(col, zone: str = "US/Central") -> Column:
    """Wall-clock time in ``zone`` of a UTC instant."""
    return F.from_utc_timestamp(_c(col), zone)


def day(col) -> Column:
    """Calendar day."""
    return F.to_date(_c(col))


def week_number(col) -> Column:
    """Lubridate ``week()``: complete 7-day blocks since 1 January, plus
    one. Not ISO ``weekofyear``."""
    return (F.floor((F.dayofyear(_c(col)) - 1) / 7) + 1).cast("int")


def weekday(col) -> Column:
    """1 = Sunday ... 7 = Saturday (same as R ``wday``)."""
    return F.dayofweek(_c(col))


def weekday_label(col) -> Column:
    """``Sun`` ... ``Sat``."""
    return F.date_format(_c(col), "EEE")


def duration_seconds(start, end) -> Column:
    """T4: whole seconds from ``start`` to ``end``."""
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def clock_seconds(col, cut: int | None = None) -> Column:
    """T5: seconds since midnight. With ``cut``, clock times at or below the
    cut count as the next day (+86,400), so a night that starts at 23:00 and
    one that starts at 01:00 sort in the right order."""
    c = _c(col)
    s = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if cut is None:
        return s
    return F.when(s <= cut, s + DAY_SECONDS).otherwise(s)


def unwrap_clock(seconds) -> Column:
    """T5: undo the +1 day shift for display."""
    s = _c(seconds)
    return F.when(s >= DAY_SECONDS, s - DAY_SECONDS).otherwise(s)


def night_date(created, start, end) -> Column:
    """A record written two or more days after it started belongs to the
    day it ended; otherwise to the day it was written."""
    return F.when(F.datediff(F.to_date(_c(created)), F.to_date(_c(start))) >= 2,
                  F.to_date(_c(end))).otherwise(F.to_date(_c(created)))


def running_week(col, base_year) -> Column:
    """Week number that keeps counting over a year end."""
    base = F.lit(base_year) if isinstance(base_year, int) else _c(base_year)
    return week_number(col) + 52 * (F.year(_c(col)) - base)


def readable_duration(seconds) -> Column:
    """``8H 3M 14S`` from a number of seconds (fraction dropped)."""
    s = F.floor(_c(seconds)).cast("long")
    return F.format_string("%dH %dM %dS", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def same_day(col, day_literal: str) -> Column:
    """Compare on the day only."""
    return F.to_date(_c(col)) == F.to_date(F.lit(day_literal))


def is_off_day(date_col, holiday_flag) -> Column:
    """Weekend or a listed holiday."""
    return F.dayofweek(_c(date_col)).isin(1, 7) | F.coalesce(_c(holiday_flag), F.lit(False))


def five_year_label(year_col) -> Column:
    """``2015-2019`` for the 5-year estimate ending in ``year``."""
    y = _c(year_col)
    return F.concat((y - 4).cast("string"), F.lit("-"), y.cast("string"))


def non_overlapping_five_year(year_col, max_year_col) -> Column:
    """Keep every fifth year counting back from the newest."""
    return ((_c(max_year_col) - _c(year_col)) % 5) == 0
