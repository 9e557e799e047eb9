"""Display names of report columns. Columns without one are shown by their own name in capitals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Display names as published, in column order.
PERCENTS = {
    "portfolio_size": "Portfolio Size",
    "contacted_by_rm": "Contacted by RM",
    "pct_contacted_by_rm": "% Contacted by RM",
    "contacted_by_anyone": "Contacted by Anyone",
    "pct_contacted_by_anyone": "% Contacted by Anyone",
    "visited_by_rm": "Visited by RM",
    "pct_visited_by_rm": "% Visited by RM",
    "visited_by_anyone": "Visited by Anyone",
    "pct_visited_by_anyone": "% Visited by Anyone",
    "date_pulled": "Date Pulled",
    "date_range": "Date Range",
}

ANALYSIS = {
    "prospect_name": "Prospect Name",
    "pq_assign_date": "PQ Assign Date",
    "pm_assign_date": "PM Assign Date",
    "rm_18_months_no_ask": "RM 18 mnths but no MG Ask",
    "prospect_stage": "Prospect Stage",
    "qualified_code": "Most Recent MG Qualified Code",
    "qualified_date": "Most Recent MG Qualified Date",
    "contacts_rm_12m": "C,P,V,Atmpt by RM (12 Mnths)",
    "contacts_rm": "C,P,V,Atmpt by RM)",
    "visits_rm_12m": "Visits by RM (12 Mnths)",
    "visits_rm": "Visits by RM",
    "latest_visit_rm": "Most Recent Visit by RM",
    "contacts_any_12m": "C,P,V,Atmpt Any DO (12 Mnths)",
    "contacts_any": "C,P,V,Atmpt Any DO",
    "visits_any_12m": "Visits Any DO (12 Mnths)",
    "visits_any": "Visits Any DO",
    "latest_visit_any": "Most Recent Visit Any DO",
    "date_pulled": "Date Pulled",
    "date_range": "Date Range",
}

FLOWS = {"prospects_added": "# of Prospects Added", "prospects_dropped": "# of Prospects Dropped"}

OM_PROPOSALS = {
    "ask_minus_capacity": "Ask - Capacity",
    "ask_date": "Ask Date",
    "close_date": "Close Date",
    "years_to_close": "Years to Close",
    "date_pulled": "Date Pulled",
    "date_range": "Data Date Range",
}

OM_PROSPECTS = {
    "assignment_start_date": "Assignment Start Date",
    "ask_date": "Ask Date",
    "visits_to_ask": "Visits from Assignment to Ask",
    "years_in_portfolio": "Years in Portfolio",
    "years_to_ask": "Years from Assignment to Ask",
    "portfolio_size": "Portfolio Size",
    "total_removed": "Total Removed",
    "date_pulled": "Date Pulled",
    "date_range": "Data Date Range",
}

# "Visits Not PQ" counts the PQ visits; the published name is kept.
OM_VISITS = {
    "author_id": "DO",
    "author_name": "DO Name",
    "visits_by_rm": "Visits By RM",
    "visits_by_non_rm": "Visits By Non RM",
    "no_rm": "Prospects With No RM Visits",
    "visits_pq": "Visits Not PQ",
    "date_pulled": "Date Pulled",
    "date_range": "Data Date Range",
}

PROPOSAL_STATS = {
    "lead_id": "Lead Solicitator ID",
    "lead_name": "Lead Solicitator",
    "rm_number": "RM Number if Active",
    "rm_name": "RM Name if Active",
    "active_ind": "Proposal Active Ind",
    "granted_of_ask": "Granted as % of Ask Amt",
    "ask_of_capacity": "Ask as % of Capacity",
    "ask_of_abs_capacity": "Ask as % of Abs Capacity",
    "ask_date": "Ask Date",
    "days_rb": "Days at Ask Planned",
    "days_am": "Days at Ask Made",
    "days_gc": "Days at Gift Closed",
    "days_st": "Days at Gift/Pledge Stwrdship",
    "days_pl": "Days at PG Stewardship",
    "days_dn": "Days at Declined",
    "days_dp": "Days at Cancelled Solicitation",
    "date_run": "Date Run",
}

# Display names of the scorecard as published, in column order: for managers, for team members.
SCORECARD = (
    ("officer_name", "RM Name", "DO Name"),
    ("officer_id", "RM Number", "DO Number"),
    ("officer_type", "DO Type", "DO Type"),
    ("years_as_officer", "Years as DO", "Years as DO"),
    ("portfolio_size", "Portfolio Size", "Portfolio Size (RM only)"),
    ("team_member_size", "Count as Team Member", "Count as Team Member"),
    ("total_qualified", "Total Qualified", "Total Qualified"),
    ("total_to_be_qualified", "Total to be Qualified", "Total to be Qualified"),
    ("ask_major_by_officer", "Total Ask Made (Major) by RM", "Total Ask Made (Major) by DO"),
    ("pct_ask_major_by_officer", "% Ask Made (Major) by RM", "% Ask Made (Major) by DO"),
    ("ask_major_any", "Total Ask Made (Major) Any DO", "Total Ask Made (Major) Any DO"),
    ("pct_ask_major_any", "% Ask Made (Major) by Any DO", "% Ask Made (Major) by Any DO"),
    ("ask_any_by_officer", "Total Ask Made (MG/A+S) by RM", "Total Ask Made (MG/A+S) by DO"),
    ("pct_ask_any_by_officer", "% Ask Made (MG/A+S) by RM", "% Ask Made (MG/A+S) by DO"),
    ("ask_special_by_officer", "Total Ask Made Special by RM", "Total Ask Made Special by DO"),
    ("pct_ask_special_by_officer", "% Ask Made Special by RM", "% Ask Made Special by DO"),
    ("ask_any_any", "Total Ask Made (MG/A+S) Any DO", "Total Ask Made (MG/A+S) Any DO"),
    ("pct_ask_any_any", "% Ask Made (MG/A+S) by Any DO", "% Ask Made (MG/A+S) by Any DO"),
    ("ask_special_any", "Total Ask Made Special Any DO", "Total Ask Made Special Any DO"),
    ("pct_ask_special_any", "% Ask Made Special by Any DO", "% Ask Made Special by Any DO"),
    ("contacted_by_officer", "Total Contacted by RM", "Total Contacted by This DO"),
    ("pct_contacted_by_officer", "% Contacted by RM", "% Contacted by This DO"),
    ("visited_by_officer", "Total Visited by RM", "Total Visited by This DO"),
    ("pct_visited_by_officer", "% Visited by RM", "% Visited by This DO"),
    ("visited_twice_by_officer", "Total Visited 2+ by RM", "Total Visited 2+ by This DO"),
    ("pct_visited_twice_by_officer", "% Visited 2+ by RM", "% Visited 2+ by This DO"),
    ("contacted_any", "Total Contacted by Any DO", "Total Contacted by Any DO"),
    ("pct_contacted_any", "% Contacted by Any DO", "% Contacted by Any DO"),
    ("visited_any", "Total Visited by Any DO", "Total Visited by Any DO"),
    ("pct_visited_any", "% Visited by Any DO", "% Visited by Any DO"),
    ("outside_entities", "Visits Outside Portfolio", "Visits Outside Portfolio"),
    ("rated_lt_50k", "Total Rated < $50k", "Total Rated < $50k"),
    ("pct_rated_lt_50k", "% Rated < $50k", "% Rated < $50k"),
    ("rated_ge_50k", "Total Rated >= $50k", "Total Rated >= $50k"),
    ("pct_rated_ge_50k", "% Rated >= $50k", "% Rated >= $50k"),
    ("rated_lt_100k", "Total Rated < $100k", "Total Rated < $100k"),
    ("pct_rated_lt_100k", "% Rated < $100k", "% Rated < $100k"),
    ("rated_ge_100k", "Total Rated >= $100k", "Total Rated >= $100k"),
    ("pct_rated_ge_100k", "% Rated >= $100k", "% Rated >= $100k"),
    ("rated_lt_1m", "Total Rated < $1M", "Total Rated < $1M"),
    ("pct_rated_lt_1m", "% Rated < $1M", "% Rated < $1M"),
    ("rated_ge_1m", "Total Rated >= $1M", "Total Rated >= $1M"),
    ("pct_rated_ge_1m", "% Rated >= $1M", "% Rated >= $1M"),
    ("gave", "Total Gave During Timeframe", "Total Gave During Timeframe"),
    ("pct_gave", "% Gave During Timeframe", "% Gave During Timeframe"),
    ("at_qualification", "Total at Qualification", "Total at Qualification"),
    ("pct_at_qualification", "% at Qualification", "% at Qualification"),
    ("pct_at_qualification_1yr", "% at Qualification for 1+ yr", "% at Qualification for 1+ yr"),
    ("at_cultivation", "Total at Cultivation", "Total at Cultivation"),
    ("pct_at_cultivation", "% at Cultivation", "% at Cultivation"),
    ("pct_at_cultivation_1yr", "% at Cultivation for 1+ yr", "% at Cultivation for 1+ yr"),
    ("at_active_solicitation", "Total at Active Solicitation", "Total at Active Solicitation"),
    ("pct_at_active_solicitation", "% at Active Solicitation", "% at Active Solicitation"),
    ("pct_at_active_solicitation_1yr", "% at Active Solic for 1+ yr", "% at Active Solic for 1+ yr"),
    ("at_stewardship", "Total at Stewardship", "Total at Stewardship"),
    ("pct_at_stewardship", "% at Stewardship", "% at Stewardship"),
    ("at_pg_stewardship", "Total at PG Stewardship", "Total at PG Stewardship"),
    ("pct_at_pg_stewardship", "% at PG Stewardship", "% at PG Stewardship"),
    ("at_permanent_stewardship", "Total at Permanent Stewardship", "Total at Permanent Stewardship"),
    ("pct_at_permanent_stewardship", "% at Permanent Stewardship", "% at Permanent Stewardship"),
    ("documented_strategy", "Total Documented Strategy", "Total Documented Strategy"),
    ("pct_documented_strategy", "% Documented Strategy", "% Documented Strategy"),
    ("dq_nn_nr_reports", "Total DQ NN NR", "Total DQ NN NR"),
    ("qualified_reports", "Total Prospects Qualified (CR)", "Total Prospects Qualified (CR)"),
    ("proposals", "Total Proposals", "Total with Proposals"),
    ("proposals_ask_made", "Total Ask Made Proposals", "Total with Ask Made Proposals"),
    ("pct_proposals_ask_made", "% Ask Made Proposals", "% with Ask Made Proposals"),
    ("proposals_dropped_before_ask", "Total Dropped Before Ask Made", "Total Dropped Before Ask Made"),
    ("pct_proposals_dropped_before_ask", "% Dropped Before Ask Made", "% Dropped Before Ask Made"),
    ("proposals_closed", "Total Proposals Closed", "Total with Proposals Closed"),
    ("pct_proposals_closed", "% Proposals Closed", "% with Proposals Closed"),
    ("pct_at_ask_planned_1yr", "% at Ask Planned 1+ yr", "% at Ask Planned 1+ yr"),
    ("pct_at_ask_made_1yr", "% at Ask Made 1+ yr", "% at Ask Made 1+ yr"),
    ("years_floor", "Years as DO Rounded Down", "Years as DO Rounded Down"),
    ("size_recommended", "Recommended Portfolio Size?", "Recommended Portfolio Size?"),
    ("rated_100k_over_half", "Portfolio rated $100k+", "Portfolio rated $100k+"),
    ("rated_lt_50k_over_quarter", "Portfolio rated < $50k", "Portfolio rated < $50k"),
    ("qualification_over_quarter", "Qualification > 25%", "Qualification > 25%"),
    ("cultivation_stewardship_half", "Cultivation/Stewardship > 50%", "Cultivation/Stewardship > 50%"),
    ("solicitation_tenth", "Active Solicitation > 10%", "Active Solicitation > 10%"),
    ("contact_quartile", "Contact by RM Quartile", "Contact by DO Quartile"),
    ("visit_quartile", "Visit by RM Quartile", "Visit by DO Quartile"),
    ("ask_major_any_quartile", "Asked Major Any DO Quartile", "Asked Major Any DO Quartile"),
    ("ask_special_quartile", "Asked Special by RM Quartile", "Asked Special by DO Quartile"),
    ("ask_made_quartile", "Ask Made Proposals Quartile", "Ask Made Proposals Quartile"),
    ("closed_quartile", "Closed Proposals Quartile", "Closed Proposals Quartile"),
    ("pq_visited", "Total PQ Visited", "Total PQ Visited"),
    ("pct_pq_visited", "% PQ Visited", "% PQ Visited"),
    ("pq_qualified", "Total PQ Qualified", "Total PQ Qualified"),
    ("pct_pq_qualified", "% Total PQ Qualified", "% Total PQ Qualified"),
    ("pm_visited", "Total PM Visited", "Total PM Visited"),
    ("pct_pm_visited", "% PM Visited", "% PM Visited"),
    ("pm_qualified", "Total PM Qualified", "Total PM Qualified"),
    ("pct_pm_qualified", "% Total PM Qualified", "% Total PM Qualified"),
    ("date_pulled", "Date Pulled", "Date Pulled"),
    ("date_range", "Data Date Range", "Data Date Range"),
)


def scorecard_labels(atype: str = "LM") -> dict[str, str]:
    """Display names of the scorecard, worded for managers ("LM") or team members ("S")."""
    return {column: manager if atype == "LM" else member for column, manager, member in SCORECARD}


def with_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The report under its display names."""
    return df.select(*[F.col(c).alias(labels.get(c, c.upper())) for c in df.columns])
