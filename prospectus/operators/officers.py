"""Per-officer portfolio sizes and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectus.functions import predicates as is_
from prospectus.functions.dates import now, years_between
from prospectus.functions.scalars import officer_type
from prospectus.operators.stages import time_at_proposal_stage, time_at_stage
from prospectus.params import ReportParams
from prospectus.sources.tables import Tables

# Stage codes whose age is counted, and prospect stage codes with the names of their count columns.
AGED_STAGES = ("Q", "CU", "SO")
AGED_PROPOSAL_STAGES = ("RB", "AM")
STAGE_COUNTS = {"Q": "n_q", "CU": "n_cu", "SO": "n_so", "ST": "n_st", "PL": "n_pl", "PS": "n_ps"}


def portfolio_size_raw(t: Tables) -> DataFrame:
    """Active manager assignments per development officer, duplicates and inactive officers included."""
    officers = t.staff.where(is_.is_development_staff()).select(F.col("id_number").alias("officer_id"), "sort")
    prospects = t.prospect.where(is_.is_active()).select("prospect_id")
    return (
        t.assignment.where(is_.is_assignment("LM"))
        .select("prospect_id", F.col("assignment_id_number").alias("officer_id"))
        .join(prospects, "prospect_id")
        .groupBy("officer_id")
        .agg(F.count("*").alias("portfolio_size"))
        .join(officers, "officer_id")
        .select("officer_id", F.col("sort").alias("officer_name"), "portfolio_size")
    )


def officer_counts(cohort: DataFrame) -> DataFrame:
    """Cohort rows per officer: in all, by priority and by prospect stage."""
    by_stage = [F.count_if(F.col("stage_code") == code).alias(name) for code, name in STAGE_COUNTS.items()]
    return cohort.groupBy("officer_id", "officer_name").agg(
        F.count("*").alias("portfolio_size"),
        F.count_if(is_.has_priority("PQ")).alias("pq_size"),
        F.count_if(is_.has_priority("PM")).alias("pm_size"),
        *by_stage,
    )


def officer_portfolio(cohort: DataFrame, t: Tables, p: ReportParams) -> DataFrame:
    """Officer counts with office, unit, years as officer and officer type."""
    started = F.coalesce("start_date", "date_added")
    staff = t.staff.select(
        F.col("id_number").alias("officer_id"),
        "office_code",
        "unit_code",
        years_between(started, now(p)).alias("years_as_officer"),
    )
    offices = t.tms_office.select("office_code", F.col("short_desc").alias("office"))
    units = t.tms_unit_code.select("unit_code", F.col("short_desc").alias("unit"))
    # staff with their lookups first: the officers' counts then keep their partitioning for the joins that follow
    described = staff.join(offices, "office_code", "left").join(units, "unit_code", "left")
    return (
        officer_counts(cohort)
        .join(described, "officer_id", "left")
        .withColumn("officer_type", officer_type(F.col("unit"), F.col("officer_id"), p))
        .drop("office_code", "unit_code")
    )


def role_size(t: Tables, atype: str) -> DataFrame:
    """Distinct active prospects an active development officer holds in the given role."""
    officers = t.staff.where(is_.is_development_staff() & is_.is_active()).select(
        F.col("id_number").alias("officer_id")
    )
    return (
        t.assignment.where(is_.is_assignment(atype))
        .select("prospect_id", F.col("assignment_id_number").alias("officer_id"))
        .join(t.prospect.where(is_.is_active()).select("prospect_id"), "prospect_id")
        .join(officers, "officer_id")
        .distinct()
        .groupBy("officer_id")
        .agg(F.count("*").alias("role_size"))
    )


def aged_stages(cohort: DataFrame, t: Tables, p: ReportParams, entries: DataFrame | None = None) -> DataFrame:
    """Officer and stage code of the prospects that have been at qualification, cultivation or solicitation for a year."""
    at = time_at_stage(cohort, t, p, entries)
    return at.where((F.col("years") >= 1) & F.col("stage_code").isin(*AGED_STAGES)).select("officer_id", "stage_code")


def aged_proposal_stages(
    cohort: DataFrame, t: Tables, p: ReportParams, entries: DataFrame | None = None
) -> DataFrame:
    """Officer and stage code of the proposals that have been at ask planned or ask made for a year."""
    at = time_at_proposal_stage(cohort, t, p, entries)
    chosen = (F.col("years") >= 1) & F.col("stage_code").isin(*AGED_PROPOSAL_STAGES)
    return at.where(chosen).select("officer_id", "stage_code")


def _per_officer(aged: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    counts = [F.count_if(F.col("stage_code") == code).alias(f"n_{code.lower()}_1y") for code in codes]
    return aged.groupBy("officer_id").agg(*counts)


def stage_age_counts(cohort: DataFrame, t: Tables, p: ReportParams) -> DataFrame:
    """Prospects that have been at qualification, cultivation or solicitation for a year or more, per officer."""
    return _per_officer(aged_stages(cohort, t, p), AGED_STAGES)


def proposal_age_counts(cohort: DataFrame, t: Tables, p: ReportParams) -> DataFrame:
    """Proposals that have been at ask planned or ask made for a year or more, per officer."""
    return _per_officer(aged_proposal_stages(cohort, t, p), AGED_PROPOSAL_STAGES)


def age_counts(cohort: DataFrame, t: Tables, p: ReportParams, entries: DataFrame | None = None) -> DataFrame:
    """Both counts in one aggregate; the codes of prospects and proposals differ."""
    aged = aged_stages(cohort, t, p, entries).unionByName(aged_proposal_stages(cohort, t, p, entries))
    return _per_officer(aged, AGED_STAGES + AGED_PROPOSAL_STAGES)
