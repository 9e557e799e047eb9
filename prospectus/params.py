"""Report parameters: dates, code lists and thresholds that the reports take instead of literals."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

Window = tuple[datetime, datetime]

# Unit codes the published officer reports leave out.
OM_EXCLUDED_UNITS = ("ASGP", "FCG")

# Rows of a key's join result that one task makes; a key with more is dealt out to parts.
ROWS_PER_PART = 1_000_000

# Smallest recommended portfolio per officer type. Types that are absent never qualify.
SIZE_MINIMUM = {
    "Planned Giving Officer": 75,
    "Principal Gifts Officer": 30,
    "Foundation and Corporate Officer": 30,
    "Annual Special": 200,
}


def _day(year: int, month: int, day: int) -> datetime:
    return datetime(year, month, day)


@dataclass(frozen=True)
class ReportParams:
    """Everything a report needs besides its tables.

    ``as_of`` is "now"; None means the session's local timestamp when the query runs.
    Windows include both ends, and the upper end is a midnight. The staff lists name people of one installation and are
    empty unless the caller gives them. ``rows_per_part`` spreads crowded keys and changes no result.
    """

    as_of: datetime | None = None
    window: Window = (_day(2015, 7, 1), _day(2017, 6, 30))
    om_window: Window = (_day(2015, 7, 1), _day(2017, 5, 15))
    year1: Window = (_day(2015, 7, 1), _day(2016, 6, 30))
    year2: Window = (_day(2016, 7, 1), _day(2017, 6, 30))
    rolling_months: int = 13
    stop_from: datetime = _day(2015, 7, 1)
    # The label of the newest year repeats the one before it; kept, because the output shows it.
    fiscal_years: tuple[tuple[Window, str], ...] = (
        ((_day(2017, 7, 1), _day(2018, 6, 30)), "FY 16-17"),
        ((_day(2016, 7, 1), _day(2017, 6, 30)), "FY 16-17"),
        ((_day(2015, 7, 1), _day(2016, 6, 30)), "FY 15-16"),
    )
    open_fiscal_year: str = "FY 17-18"
    exclude_staff: tuple[str, ...] = ()
    exclude_units: tuple[str, ...] = OM_EXCLUDED_UNITS
    special_officers: tuple[str, ...] = ()
    leadership: tuple[str, ...] = ()
    size_minimum: dict[str, int] = field(default_factory=lambda: dict(SIZE_MINIMUM))
    label_date_format: str = "dd-MMM-yy"
    rows_per_part: int = ROWS_PER_PART


def window_label(window: Window) -> str:
    """``7/1/2015 - 6/30/2017``: the text the fixed-window reports print."""
    return " - ".join(f"{d.month}/{d.day}/{d.year}" for d in window)
