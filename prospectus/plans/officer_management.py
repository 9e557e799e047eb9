"""Officer-management reports: proposals, time to ask, and visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectus.functions import predicates as is_
from prospectus.functions.dates import now, rounded_years
from prospectus.operators.cohorts import om_cohort
from prospectus.operators.contacts import first_ask, visits_by_author, visits_to_ask
from prospectus.operators.fan_out import fan_out_join
from prospectus.operators.giving import primary_pool
from prospectus.params import ReportParams, window_label
from prospectus.sources.shared import shared
from prospectus.sources.tables import Tables


def _stamp(p: ReportParams) -> dict[str, Column]:
    return {"date_pulled": now(p), "date_range": F.lit(window_label(p.om_window))}


def om_proposals(t: Tables, p: ReportParams) -> DataFrame:
    """Major-gift proposals of managed prospects, once per cohort row of the prospect."""
    pool = primary_pool(t).select("prospect_id", "abs_high_capacity_ucdt_asks", "abs_high_capacity_ucdt_ask_lvl")
    proposals = t.proposal.where(is_.is_major_gift() & is_.in_window("start_date", p.om_window))
    cohort = shared(om_cohort(t, p).select("prospect_id"))
    held = cohort.join(pool, "prospect_id", "left")
    sizes = (proposals.select("prospect_id"), cohort)
    return (
        fan_out_join(
            proposals, held, key="prospect_id", how="inner", sized_by=sizes, rows_per_part=p.rows_per_part
        )
        .select(
            "proposal_id",
            "prospect_id",
            "start_date",
            "stop_date",
            "active_ind",
            "proposal_status_code",
            "stage_code",
            "original_ask_amt",
            "ask_amt",
            "anticipated_amt",
            "granted_amt",
            "abs_high_capacity_ucdt_asks",
            "abs_high_capacity_ucdt_ask_lvl",
            (F.col("ask_amt") - F.col("abs_high_capacity_ucdt_asks")).alias("ask_minus_capacity"),
            F.col("initial_contribution_date").alias("ask_date"),
            F.col("expected_date").alias("close_date"),
            rounded_years(F.col("initial_contribution_date"), F.col("expected_date")).alias("years_to_close"),
        )
        .withColumns(_stamp(p))
    )


def removed_by_rm(cohort: DataFrame, t: Tables, p: ReportParams) -> DataFrame:
    """Manager assignments of the officer's prospects that ended in the window, per officer name."""
    ended = (
        t.assignment.where(is_.is_assignment("LM", active=False) & is_.in_window("stop_date", p.om_window))
        .groupBy("prospect_id")
        .agg(F.count("*").alias("ended"))
    )
    removed = F.sum(F.col("rows") * F.coalesce("ended", F.lit(0))).alias("total_removed")
    rows = cohort.groupBy("prospect_id", "officer_name").agg(F.count("*").alias("rows"))
    return rows.join(ended, "prospect_id", "left").groupBy("officer_name").agg(removed)


def om_officer_sizes(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("officer_id", "officer_name").agg(
        F.count("*").alias("portfolio_size"), F.count_if(is_.has_priority("PQ")).alias("pq_size")
    )


def om_prospects(t: Tables, p: ReportParams) -> DataFrame:
    """Time and visits from assignment to ask.

    Ask dates are per officer and start but join on the prospect alone, and visits are per prospect, as published.
    """
    cohort = shared(om_cohort(t, p))
    asks = shared(first_ask(cohort, t))
    ask_dates = asks.select("prospect_id", "ask_date")
    sizes = om_officer_sizes(cohort).select("officer_id", "portfolio_size")
    started = F.col("start_date")
    rows = (
        cohort.join(visits_to_ask(asks), "prospect_id", "left")
        .join(removed_by_rm(cohort, t, p), "officer_name", "left")
        .join(sizes, "officer_id", "left")
    )
    return (
        fan_out_join(
            rows, ask_dates, key="prospect_id", sized_by=(cohort, asks), rows_per_part=p.rows_per_part
        )
        .select(
            "prospect_id",
            F.col("officer_name").alias("rm_name"),
            started.alias("assignment_start_date"),
            "ask_date",
            F.col("visits").alias("visits_to_ask"),
            rounded_years(started, now(p)).alias("years_in_portfolio"),
            rounded_years(started, F.col("ask_date")).alias("years_to_ask"),
            "portfolio_size",
            "total_removed",
        )
        .withColumns(_stamp(p))
    )


def om_visits(t: Tables, p: ReportParams) -> DataFrame:
    return visits_by_author(t, p).withColumns(_stamp(p)).orderBy(F.col("author_name").asc_nulls_last())
