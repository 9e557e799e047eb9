"""Date arithmetic on TIMESTAMP_NTZ columns, with the rules of the source system's DATE type."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectus.params import ReportParams

MICROS_PER_DAY = 86_400_000_000


def ts(value: datetime) -> Column:
    """A naive datetime as a TIMESTAMP_NTZ literal, whatever the session time zone is."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def parse_date(text: Column, pattern: str = "M/d/yyyy") -> Column:
    """Text such as ``7/1/2015`` as midnight of that day."""
    return F.to_date(text, pattern).cast("timestamp_ntz")


def now(p: ReportParams) -> Column:
    return F.localtimestamp() if p.as_of is None else ts(p.as_of)


def add_months(at: Column, months: int) -> Column:
    """Shift by whole months, keeping the time of day.

    The last day of a month maps to the last day of the target month, and a day the target month
    lacks becomes its last day. Spark's interval arithmetic has only the second rule.
    """
    moved = at + F.make_ym_interval(F.lit(0), F.lit(months))
    to_month_end = F.dayofmonth(F.last_day(moved)) - F.dayofmonth(moved)
    at_month_end = F.dayofmonth(at) == F.dayofmonth(F.last_day(at))
    return F.when(at_month_end, moved + F.make_dt_interval(to_month_end)).otherwise(moved)


def rolling_start(p: ReportParams, days_earlier: int = 0) -> Column:
    start = add_months(now(p), -p.rolling_months)
    return start - F.make_dt_interval(F.lit(days_earlier)) if days_earlier else start


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def days_between(start: Column, end: Column) -> Column:
    """Days from start to end with their fraction, as a double."""
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def years_between(start: Column, end: Column) -> Column:
    return days_between(start, end) / F.lit(365.0)


def rounded_years(start: Column, end: Column) -> Column:
    return F.round(years_between(start, end), 2)


def rolling_label(p: ReportParams) -> Column:
    """First and last day of the rolling window, e.g. ``01-JUL-00 - 02-AUG-01``."""
    days = (rolling_start(p, days_earlier=1), now(p))
    return F.concat_ws(" - ", *[F.upper(F.date_format(d, p.label_date_format)) for d in days])
