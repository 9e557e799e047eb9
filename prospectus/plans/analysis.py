"""One row per managed prospect: profile, asks, giving, contacts and a traffic-light assessment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectus.functions import predicates as is_
from prospectus.functions.dates import now, rolling_label, rounded_years
from prospectus.functions.scalars import ask_gap_flag, assessment
from prospectus.operators.cohorts import cohort_pairs, prospect_cohort
from prospectus.operators.contacts import (
    by_cohort_officer,
    contacts_by_officer,
    contacts_by_prospect,
    coverage_tallies,
    last_qualification,
    recent_contacts_by_officer,
)
from prospectus.operators.fan_out import fan_out_join
from prospectus.operators.giving import last_annual_fund_gift, last_gift, primary_pool
from prospectus.operators.proposals import max_planned_ask_date
from prospectus.params import ReportParams
from prospectus.sources.shared import shared
from prospectus.sources.tables import Tables


def pool_sheet(t: Tables) -> DataFrame:
    """Primary pool rows with last gift, last annual-fund gift and the date of the planned ask."""
    planned = max_planned_ask_date(t).withColumnsRenamed(
        {"ask_amt": "high_act_ask_plan", "planned_ask_date": "high_act_ask_plan_date"}
    )
    return (
        primary_pool(t)
        .join(last_gift(t), "id_number", "left")
        .join(last_annual_fund_gift(t), "id_number", "left")
        .join(planned, ["prospect_id", "high_act_ask_plan"], "left")
    )


def portfolio_analysis(t: Tables, p: ReportParams) -> DataFrame:
    """The prospect sheet.

    The officers' own contact rows join on the prospect alone, all-time and rolling rows separately, so a prospect with
    several officers yields a row for every combination. That is the published result and is kept; the rows are few,
    because each side is aggregated to one row per author.
    """
    cohort = shared(prospect_cohort(t, named=False, require_active_staff=False, start="fallback"))
    tallies = shared(coverage_tallies(t, p, days_earlier=1))
    held = shared(by_cohort_officer(cohort_pairs(cohort), tallies))

    own = contacts_by_officer(held).drop("author_id")
    own = own.withColumnsRenamed({"contacts": "contacts_rm", "visits": "visits_rm", "latest_visit": "latest_visit_rm"})
    own_recent = recent_contacts_by_officer(held).drop("author_id")
    own_recent = own_recent.withColumnsRenamed({"recent_contacts": "contacts_rm_12m", "recent_visits": "visits_rm_12m"})
    anyone = contacts_by_prospect(cohort, tallies).withColumnsRenamed(
        {
            "contacts": "contacts_any",
            "visits": "visits_any",
            "recent_contacts": "contacts_any_12m",
            "recent_visits": "visits_any_12m",
            "latest_visit": "latest_visit_any",
        }
    )
    staff = t.staff.select(F.col("id_number").alias("officer_id"), F.col("sort").alias("rm_name"), "unit_code")
    units = t.tms_unit_code.select("unit_code", F.col("full_desc").alias("rm_area"))
    stages = t.tms_stage.select("stage_code", F.col("full_desc").alias("stage_full_desc"))
    qualified = last_qualification(t).withColumnsRenamed(
        {"contact_outcome": "qualified_code", "contact_date": "qualified_date"}
    )

    sheet = (
        cohort.join(staff, "officer_id", "left")
        .join(units, "unit_code", "left")
        .join(stages, "stage_code", "left")
        .join(anyone, "prospect_id", "left")
        .join(qualified, "prospect_id", "left")
        .join(pool_sheet(t), "prospect_id", "left")
    )
    sizes = (cohort, held, held)
    sheet = fan_out_join(
        sheet, own, own_recent, key="prospect_id", sized_by=sizes, rows_per_part=p.rows_per_part
    )
    held_since, today = F.col("start_date"), now(p)
    sheet = sheet.withColumn("years_as_rm", rounded_years(held_since, today))
    sheet = sheet.withColumn("_verdict", assessment(F.col("years_as_rm"), p))

    def start_if(priority: str):
        return F.when(is_.has_priority(priority), held_since)

    return sheet.select(
        "prospect_id",
        F.col("id_number").alias("entity_id"),
        "pers_org_ind",
        F.col("sort_name").alias("prospect_name"),
        "pref_mail_name",
        "age",
        "spouse_age",
        "record_type_code",
        "spouse_record_type_code",
        "home_business_state",
        "home_business_county",
        "rm_name",
        "rm_area",
        start_if("PQ").alias("pq_assign_date"),
        start_if("PM").alias("pm_assign_date"),
        "high_act_ask_plan_date",
        "high_act_ask_plan",
        "highest_active_ask",
        "abs_high_capacity_ucdt_asks",
        "abs_high_capacity_ucdt_ask_lvl",
        "high_ucdt_or_capacity",
        "lifetime_giving_devel",
        "first_fy_gift",
        "first_fy_major_gift",
        "last_fy_gift",
        "last_fy_major_gift",
        "nbr_giving_yrs",
        "nbr_of_gifts",
        "gift_in_each_of_last_3_fy",
        "last_contact_date",
        "last_contact_author",
        F.col("last_contact_attempt").alias("last_contact_attempt_date"),
        "last_contact_attempt_auth",
        "date_last_face_2_face",
        "last_face2face_author",
        "date_last_mg_ask",
        "last_mg_ask_author",
        ask_gap_flag(held_since, F.col("date_last_mg_ask"), p).alias("rm_18_months_no_ask"),
        "af_last_amt",
        "af_last_date",
        F.col("stage_full_desc").alias("prospect_stage"),
        "qualified_code",
        "qualified_date",
        "contacts_rm_12m",
        "contacts_rm",
        "visits_rm_12m",
        "visits_rm",
        "latest_visit_rm",
        "contacts_any_12m",
        "contacts_any",
        "visits_any_12m",
        "visits_any",
        "latest_visit_any",
        "years_as_rm",
        "last_gift_date",
        F.col("_verdict.code").alias("assessment"),
        F.col("_verdict.reason").alias("assessment_reason"),
        today.alias("date_pulled"),
        rolling_label(p).alias("date_range"),
    )
