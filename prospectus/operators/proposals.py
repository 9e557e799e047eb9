"""Proposals per prospect, planned asks and lead solicitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectus.functions import predicates as is_
from prospectus.operators.cohorts import cohort_rows_per_prospect
from prospectus.operators.ranking import latest_by
from prospectus.params import ReportParams
from prospectus.sources.tables import Tables


# Stage codes that "dropped before ask" looks for.
HISTORY_CODES = ("DP", *is_.ASK_IN_HISTORY)


def proposal_history(t: Tables, entries: DataFrame | None = None) -> DataFrame:
    """Per proposal, whether its stage history holds a cancellation and whether it holds an ask.

    One aggregate over the history answers both membership tests of "dropped before ask". ``entries`` is the history with
    repeated entries left out (``newest_entries``).
    """
    codes = HISTORY_CODES
    return (
        (t.stage if entries is None else entries).where(F.col("stage_code").isin(*codes) & F.col("proposal_id").isNotNull())
        .groupBy("proposal_id")
        .agg(
            F.max(F.col("stage_code") == "DP").alias("cancelled"),
            F.max(F.col("stage_code").isin(*is_.ASK_IN_HISTORY)).alias("asked"),
        )
    )


def windowed_proposals(t: Tables, p: ReportParams, entries: DataFrame | None = None) -> DataFrame:
    """Major-gift proposals started in the window, marked if dropped before an ask.

    History counts only for proposals added in the window.
    """
    dropped = is_.in_window("date_added", p.window) & F.col("cancelled") & ~F.col("asked")
    return (
        t.proposal.where(is_.is_major_gift() & is_.in_window("start_date", p.window))
        .select("proposal_id", "prospect_id", "stage_code", "date_added")
        .join(proposal_history(t, entries), "proposal_id", "left")
        .select("proposal_id", "prospect_id", "stage_code", F.coalesce(dropped, F.lit(False)).alias("dropped"))
    )


def prospect_proposals(t: Tables, p: ReportParams, entries: DataFrame | None = None) -> DataFrame:
    """Proposal counts per prospect with any in the window."""
    return (
        windowed_proposals(t, p, entries)
        .where(F.col("prospect_id").isNotNull())
        .groupBy("prospect_id")
        .agg(
            F.count("proposal_id").alias("proposals"),
            F.count_if(F.col("stage_code").isin(*is_.ASK_MADE_STAGES)).alias("ask_made"),
            F.count_if(F.col("dropped")).alias("dropped_before_ask"),
            F.count_if(F.col("stage_code").isin(*is_.CLOSED_STAGES)).alias("closed"),
        )
    )


def proposal_counts(cohort: DataFrame, t: Tables, p: ReportParams) -> DataFrame:
    """Proposal counts per cohort prospect with any. All but the dropped ones are counted once per cohort row."""
    times_rows = {c: F.col(c) * F.col("rows") for c in ("proposals", "ask_made", "closed")}
    return (
        cohort_rows_per_prospect(cohort)
        .join(prospect_proposals(t, p), "prospect_id")
        .withColumns(times_rows)
        .select("prospect_id", "proposals", "ask_made", "dropped_before_ask", "closed")
    )


def max_planned_ask_date(t: Tables) -> DataFrame:
    """Latest planned date per (prospect, amount) of active planned major-gift asks."""
    planned = is_.is_major_gift() & is_.is_active() & (F.col("stage_code") == "RB")
    return (
        t.proposal.where(planned)
        .groupBy("prospect_id", "ask_amt")
        .agg(F.max("initial_contribution_date").alias("planned_ask_date"))
    )


def lead_solicitors(t: Tables) -> DataFrame:
    """The newest lead solicitor per proposal, with the staff name if there is one."""
    leads = t.assignment.where(is_.is_assignment("SL", active=None)).select(
        "proposal_id", F.col("assignment_id_number").alias("lead_id"), "start_date"
    )
    names = t.staff.select(F.col("id_number").alias("lead_id"), F.col("sort").alias("lead_name"))
    newest = latest_by(leads, ["proposal_id"], "start_date", ["lead_id"]).drop("start_date")
    return newest.join(names, "lead_id", "left").select("proposal_id", "lead_id", "lead_name")
