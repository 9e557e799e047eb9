"""Prospects that entered and left portfolios over two fiscal years.

The published queries name an assignment type, but only inside the condition of a left join whose rows are then made
distinct without it. It cannot change the count, so manager and team-member versions are one function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectus.functions import predicates as is_
from prospectus.params import ReportParams
from prospectus.sources.tables import Tables


def _yearly(t: Tables, p: ReportParams, date: str, total: str) -> DataFrame:
    moved = t.prospect.where(is_.in_window(date, p.window)).select("prospect_id", date).distinct()
    return moved.agg(
        F.count("prospect_id").alias(total),
        F.count_if(is_.in_window(date, p.year1)).alias("year1"),
        F.count_if(is_.in_window(date, p.year2)).alias("year2"),
    )


def prospects_added(t: Tables, p: ReportParams) -> DataFrame:
    return _yearly(t, p, "start_date", "prospects_added")


def prospects_dropped(t: Tables, p: ReportParams) -> DataFrame:
    return _yearly(t, p, "stop_date", "prospects_dropped")


def dropped_after_outcome(t: Tables, p: ReportParams) -> DataFrame:
    """Prospects stopped in the window that have a "not now" or "disqualified" report at any time."""
    turned_down = t.contact_report.where(is_.outcome_in(*is_.DROPPED_OUTCOMES)).select("prospect_id").distinct()
    stopped = t.prospect.where(is_.in_window("stop_date", p.window)).select("prospect_id")
    return stopped.join(turned_down, "prospect_id", "left_semi").distinct()


def dropped_nn_dq(t: Tables, p: ReportParams) -> DataFrame:
    return dropped_after_outcome(t, p).agg(F.count("prospect_id").alias("dropped_nn_dq"))
