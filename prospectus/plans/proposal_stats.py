"""One row per proposal and manager: amounts, ratios, lead solicitor and days at each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectus.functions.dates import now
from prospectus.functions.predicates import PROPOSAL_STAGES
from prospectus.functions.scalars import safe_ratio
from prospectus.operators.cohorts import listed_keys, listed_proposals, with_managers
from prospectus.operators.proposals import lead_solicitors
from prospectus.operators.stages import stage_days
from prospectus.params import ReportParams
from prospectus.sources.shared import shared
from prospectus.sources.tables import Tables


def proposal_stats(t: Tables, p: ReportParams) -> DataFrame:
    listed = shared(listed_keys(t, p))
    detailed = (
        listed_proposals(t, p)
        .join(lead_solicitors(t), "proposal_id", "left")
        .join(stage_days(t, p, listed), "proposal_id", "left")
    )
    asked = F.col("ask_amt")
    return (
        with_managers(detailed, t, p, listed)
        .select(
            "proposal_id",
            "proposal_type",
            "proposal_title",
            "prospect_id",
            "prospect_name",
            "lead_id",
            "lead_name",
            "rm_number",
            "rm_name",
            "priority_code",
            "assignment_type",
            "active_ind",
            "proposal_status_desc",
            "current_stage_desc",
            "start_date",
            "stop_date",
            "fiscal_year",
            "original_ask_amt",
            "ask_amt",
            "granted_amt",
            safe_ratio(F.col("granted_amt"), asked).alias("granted_of_ask"),
            "high_ucdt_or_capacity",
            safe_ratio(asked, F.col("high_ucdt_or_capacity")).alias("ask_of_capacity"),
            "abs_high_capacity_ucdt_asks",
            safe_ratio(asked, F.col("abs_high_capacity_ucdt_asks")).alias("ask_of_abs_capacity"),
            F.col("initial_contribution_date").alias("ask_date"),
            "expected_date",
            "plan_gift_ind",
            "unit_code",
            *[f"days_{code.lower()}" for code in PROPOSAL_STAGES],
            now(p).alias("date_run"),
        )
    )
