"""Who manages which prospect: the row sets every report starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectus.functions import predicates as is_
from prospectus.functions.scalars import fiscal_year
from prospectus.operators.fan_out import fan_out_join
from prospectus.params import ReportParams
from prospectus.sources.shared import shared
from prospectus.sources.tables import Tables

# Lookups, staff and other small tables carry no broadcast hint anywhere in this package: Spark broadcasts a side when
# its statistics, or the sizes seen at run time, are under spark.sql.autoBroadcastJoinThreshold, and merges otherwise.


def prospect_cohort(
    t: Tables,
    atype: str = "LM",
    *,
    named: bool = True,
    require_active_staff: bool = True,
    start: str | None = None,
    exclude_staff: tuple[str, ...] = (),
    exclude_units: tuple[str, ...] = (),
) -> DataFrame:
    """Distinct active prospects with an active assignment of ``atype`` to a development officer.

    One row per prospect, officer, priority (and start date, if asked for): a prospect with two officers or two
    priorities has several rows, and the reports count them all. ``named`` adds officer and stage names and the
    assignment type. ``start`` is None, "assigned", or "fallback" (date added where the start is missing).
    """
    officers = t.staff.where(is_.is_development_staff())
    if require_active_staff:
        officers = officers.where(is_.is_active())
    if exclude_staff:
        officers = officers.where(~F.col("id_number").isin(*exclude_staff))
    if exclude_units:
        officers = officers.where(~F.col("unit_code").isin(*exclude_units))
    officers = officers.select(F.col("id_number").alias("officer_id"), F.col("sort").alias("officer_name"))

    started = F.col("start_date") if start != "fallback" else F.coalesce("start_date", "date_added")
    held = t.assignment.where(is_.is_assignment(atype)).select(
        "prospect_id",
        F.col("assignment_id_number").alias("officer_id"),
        "priority_code",
        "assignment_type",
        started.alias("start_date"),
    )
    prospects = t.prospect.where(is_.is_active()).select("prospect_id", "stage_code")
    cohort = held.join(officers, "officer_id").join(prospects, "prospect_id")

    columns = ["prospect_id", "officer_id", "stage_code", "priority_code"]
    if named:
        names = t.tms_stage.select("stage_code", F.col("short_desc").alias("stage_desc"))
        cohort = cohort.join(names, "stage_code", "left")
        columns += ["officer_name", "stage_desc", "assignment_type"]
    if start:
        columns.append("start_date")
    return cohort.select(*columns).distinct()


def om_cohort(t: Tables, p: ReportParams) -> DataFrame:
    """The cohort of the officer-management reports: with start dates, without listed staff and units."""
    return prospect_cohort(t, start="assigned", exclude_staff=p.exclude_staff, exclude_units=p.exclude_units)


def cohort_pairs(cohort: DataFrame) -> DataFrame:
    """Cohort rows per (prospect, officer), in all and by priority.

    The published queries join cohort rows to events one by one, so these counts are the multiplicity of every event
    aggregate. Aggregating first and multiplying afterwards gives the same numbers without repeating events.
    """
    return cohort.groupBy("prospect_id", "officer_id").agg(
        F.count("*").alias("rows"),
        F.count_if(is_.has_priority("PQ")).alias("pq_rows"),
        F.count_if(is_.has_priority("PM")).alias("pm_rows"),
    )


def cohort_rows_per_prospect(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("prospect_id").agg(F.count("*").alias("rows"))


def held_entities(t: Tables) -> DataFrame:
    """(officer, prospect, entity) of active manager and team assignments without a proposal; may repeat."""
    held = t.assignment.where(is_.is_assignment("S", "LM") & F.col("proposal_id").isNull())
    entities = t.prospect_entity.select("prospect_id", F.col("id_number").alias("entity_id"))
    return (
        held.select(F.col("assignment_id_number").alias("officer_id"), "prospect_id")
        .join(entities, "prospect_id", "left")
        .select("officer_id", "prospect_id", "entity_id")
    )


def all_assignments(t: Tables, cohort: DataFrame) -> DataFrame:
    """Distinct (officer, prospect, entity) held as manager or team member by the officers of the cohort."""
    officers = cohort.select("officer_id").distinct()
    return held_entities(t).join(officers, "officer_id", "left_semi").distinct()


def listed_proposals(t: Tables, p: ReportParams) -> DataFrame:
    """Major-gift proposals that are open or stopped since ``stop_from``, with their own names and labels."""
    status = t.tms_proposal_status.withColumnRenamed("short_desc", "proposal_status_desc")
    stages = t.tms_proposal_stage.select(
        F.col("stage_code").alias("current_stage"), F.col("short_desc").alias("current_stage_desc")
    )
    return (
        t.proposal.where(is_.is_major_gift() & is_.open_or_stopped_since("stop_date", p.stop_from))
        .withColumnRenamed("stage_code", "current_stage")
        .withColumn("fiscal_year", fiscal_year("stop_date", p))
        .join(status, "proposal_status_code", "left")
        .join(stages, "current_stage", "left")
        .drop("date_added", "anticipated_amt")
    )


def listed_keys(t: Tables, p: ReportParams) -> DataFrame:
    """Proposal and prospect of the listed proposals."""
    listed = t.proposal.where(is_.is_major_gift() & is_.open_or_stopped_since("stop_date", p.stop_from))
    return listed.select("proposal_id", "prospect_id")


def with_managers(proposals: DataFrame, t: Tables, p: ReportParams, listed: DataFrame | None = None) -> DataFrame:
    """Listed proposals with their prospect's profile, once per distinct active manager of the prospect.

    Every side is made distinct on what it contributes before the join. With the proposal key in the row the result is
    distinct by itself, which saves a shuffle of the full-width rows. This is the join that multiplies rows, so whatever
    else a proposal needs is joined before it.
    """
    held = t.assignment.where(is_.is_assignment("LM") & F.col("prospect_id").isNotNull())
    primary = t.prospect_entity.where(is_.is_primary("primary_ind") & F.col("prospect_id").isNotNull())
    managers = (
        held.select("prospect_id", "priority_code", "assignment_type", F.col("assignment_id_number").alias("_holder"))
        .distinct()
        .join(
            t.staff.where(is_.is_active()).select(
                F.col("id_number").alias("rm_number"), F.col("sort").alias("rm_name")
            ),
            F.col("_holder") == F.col("rm_number"),
            "left",
        )
        .select("prospect_id", "priority_code", "assignment_type", "rm_number", "rm_name")
        .distinct()
    )
    managers = shared(managers)
    entities = (
        primary.select("prospect_id", "id_number")
        .join(
            t.ucdr_prospect_pool.select(
                "id_number",
                F.col("sort_name").alias("prospect_name"),
                "high_ucdt_or_capacity",
                "abs_high_capacity_ucdt_asks",
            ),
            "id_number",
            "left",
        )
        .drop("id_number")
        .distinct()
    )
    listed = listed_keys(t, p) if listed is None else listed
    sizes = tuple(side.select("prospect_id") for side in (listed, primary, managers))
    return fan_out_join(
        proposals, entities, managers, key="prospect_id", sized_by=sizes, rows_per_part=p.rows_per_part
    )


def proposal_cohort(t: Tables, p: ReportParams) -> DataFrame:
    """Listed proposals, once per distinct active manager."""
    return with_managers(listed_proposals(t, p), t, p).select(
        "proposal_id",
        "prospect_id",
        "prospect_name",
        "priority_code",
        "assignment_type",
        "rm_number",
        "rm_name",
        "proposal_type",
        "active_ind",
        "proposal_status_code",
        "proposal_status_desc",
        "current_stage",
        "current_stage_desc",
        "start_date",
        "stop_date",
        "fiscal_year",
        "proposal_title",
        "original_ask_amt",
        "ask_amt",
        "granted_amt",
        "initial_contribution_date",
        "plan_gift_ind",
        "unit_code",
        "expected_date",
        "high_ucdt_or_capacity",
        "abs_high_capacity_ucdt_asks",
    )
