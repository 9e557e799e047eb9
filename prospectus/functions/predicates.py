"""Row predicates the reports share. Each returns a Column; null means "not selected"."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectus.functions.dates import now, rolling_start, ts
from prospectus.params import ReportParams, Window

# Codes stored in the source tables.
CONTACT_TYPES = ("C", "V", "P", "1")
MEETING_TYPES = ("V", "C", "P")
CALL_TYPES = ("C", "P")
VISIT_INITIATOR = "FCGS"
UNFAVOURABLE = ("DD", "NN", "NR")
DROPPED_OUTCOMES = ("NN", "DQ")
NOT_QUALIFYING = ("DU", "QO", " ")
ASK_MADE_STAGES = ("AM", "DN", "GC", "PL", "ST")
ASK_IN_HISTORY = ("AM", "GC", "DN", "ST")
CLOSED_STAGES = ("GC", "PL", "ST")
QUALIFIED_STAGES = ("ST", "CU", "SO")
PROPOSAL_STAGES = ("RB", "AM", "GC", "ST", "PL", "DN", "DP")
GIFT_OR_PLEDGE = ("P", "G")


def is_active(column: str = "active_ind") -> Column:
    return F.col(column) == "Y"


def is_primary(column: str) -> Column:
    return F.col(column) == "Y"


def is_visit() -> Column:
    """A visit, or a call or letter that counts as one because of who initiated it."""
    kind = F.col("contact_type")
    return (kind == "V") | (kind.isin(*CALL_TYPES) & (F.col("contact_initiated_by") == VISIT_INITIATOR))


def is_contact() -> Column:
    return F.col("contact_type").isin(*CONTACT_TYPES)


def has_purpose(*codes: str) -> Column:
    return F.col("contact_purpose_code").isin(*codes) & F.col("contact_type").isin(*MEETING_TYPES)


def is_ask() -> Column:
    return has_purpose("A")


def is_special() -> Column:
    return has_purpose("B")


def is_ask_or_special() -> Column:
    return has_purpose("A", "B")


def is_strategy() -> Column:
    return F.col("contact_type") == "S"


def outcome_in(*codes: str) -> Column:
    return F.col("contact_outcome").isin(*codes)


def has_outcome() -> Column:
    """An outcome other than the single-blank "none"; a null outcome does not count."""
    return F.col("contact_outcome") != " "


def is_qualification() -> Column:
    return ~outcome_in(*NOT_QUALIFYING)


def in_window(column: str, window: Window) -> Column:
    return F.col(column).between(ts(window[0]), ts(window[1]))


def in_rolling(column: str, p: ReportParams, days_earlier: int = 0) -> Column:
    return F.col(column).between(rolling_start(p, days_earlier), now(p))


def is_major_gift(column: str = "proposal_type") -> Column:
    return F.col(column).startswith("MG")


def is_gift_or_pledge() -> Column:
    return F.col("giving_ind").isin(*GIFT_OR_PLEDGE)


def is_annual_fund() -> Column:
    return (F.col("prog_hier_num") == "1") & is_gift_or_pledge()


def open_or_stopped_since(column: str, day: datetime) -> Column:
    return F.col(column).isNull() | (F.col(column) >= ts(day))


def is_development_staff() -> Column:
    return F.col("staff_type_code") == "DEV"


def is_assignment(*types: str, active: bool | None = True) -> Column:
    """Assignments of the given types; ``active=None`` leaves the active flag unread."""
    kind = F.col("assignment_type").isin(*types)
    return kind if active is None else kind & (F.col("active_ind") == ("Y" if active else "N"))


def has_priority(code: str) -> Column:
    return F.col("priority_code") == code
