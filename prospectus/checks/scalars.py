"""Derived values and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectus.checks import sqltext as s
from prospectus.checks.registry import check
from prospectus.functions import dates, scalars
from prospectus.functions import predicates as is_
from prospectus.operators.cohorts import prospect_cohort
from prospectus.operators.giving import primary_pool
from prospectus.operators.officers import officer_portfolio
from prospectus.operators.proposals import prospect_proposals
from prospectus.params import window_label
from prospectus.plans import portfolio_analysis
from prospectus.sources.staged import STAGED_PARAMS as P


@check(
    "scl_to_date",
    """SELECT prospect_id, strftime(start_date, '%-m/%-d/%Y') AS written,
    strptime(strftime(start_date, '%-m/%-d/%Y'), '%m/%d/%Y') AS parsed FROM prospect""",
)
def _(t, p):
    written = F.date_format("start_date", "M/d/yyyy")
    return t.prospect.select("prospect_id", written.alias("written"), dates.parse_date(written).alias("parsed"))


def _shifted(by: str) -> str:
    """Month shift that maps the last day of a month to the last day of the other, time of day kept."""
    time_of_day = "(contact_date - date_trunc('day', contact_date))"
    return (
        f"CASE WHEN CAST(contact_date AS DATE) = last_day(contact_date) "
        f"THEN CAST(last_day(contact_date {by}) AS TIMESTAMP) + {time_of_day} ELSE contact_date {by} END"
    )


@check(
    "scl_add_months",
    f"SELECT DISTINCT contact_date, {_shifted('- INTERVAL 13 MONTH')} AS earlier, "
    f"{_shifted('+ INTERVAL 1 MONTH')} AS later FROM contact_report",
)
def _(t, p):
    at = F.col("contact_date")
    shifted = (dates.add_months(at, -p.rolling_months).alias("earlier"), dates.add_months(at, 1).alias("later"))
    return t.contact_report.select("contact_date").distinct().select("contact_date", *shifted)


@check(
    "scl_days_between",
    f"""SELECT proposal_id, {s.days('start_date', 'stop_date')} AS days_open,
    {s.days('start_date', s.NOW)} AS days_since FROM proposal""",
)
def _(t, p):
    started = F.col("start_date")
    return t.proposal.select(
        "proposal_id",
        dates.days_between(started, F.col("stop_date")).alias("days_open"),
        dates.days_between(started, dates.now(p)).alias("days_since"),
    )


@check(
    "scl_years",
    f"""SELECT proposal_id, {s.years('start_date', s.NOW)} AS years,
    {s.years2('initial_contribution_date', 'expected_date')} AS years_to_close FROM proposal""",
)
def _(t, p):
    return t.proposal.select(
        "proposal_id",
        dates.years_between(F.col("start_date"), dates.now(p)).alias("years"),
        dates.rounded_years(F.col("initial_contribution_date"), F.col("expected_date")).alias("years_to_close"),
    )


@check(
    "scl_days_over_12",
    f"""SELECT assignment_id_number, prospect_id, start_date, {s.days('start_date', s.NOW)} / 12 < 18 AS recent
    FROM assignment""",
)
def _(t, p):
    recent = dates.days_between(F.col("start_date"), dates.now(p)) / 12 < 18
    return t.assignment.select(
        "assignment_id_number", "prospect_id", "start_date", recent.alias("recent")
    )


@check(
    "scl_trunc_number",
    f"""SELECT id_number, CAST(trunc({s.years('coalesce(start_date, date_added)', s.NOW)}) AS BIGINT) AS whole_years
    FROM staff""",
)
def _(t, p):
    years = dates.years_between(F.coalesce("start_date", "date_added"), dates.now(p))
    return t.staff.select("id_number", years.cast("bigint").alias("whole_years"))


@check(
    "scl_coalesce_case",
    """SELECT prospect_id, assignment_id_number, assignment_type, priority_code, start_date, date_added,
    CASE WHEN start_date IS NULL THEN date_added ELSE start_date END AS held_since FROM assignment""",
)
def _(t, p):
    columns = ("prospect_id", "assignment_id_number", "assignment_type", "priority_code", "start_date", "date_added")
    return t.assignment.select(*columns, F.coalesce("start_date", "date_added").alias("held_since"))


@check(
    "scl_priority_dates",
    s.with_cohort(
        """SELECT prospect_id, officer_id, CASE priority_code WHEN 'PQ' THEN start_date END AS pq_date,
        CASE priority_code WHEN 'PM' THEN start_date END AS pm_date FROM cohort""",
        s.MANAGED_FALLBACK,
    ),
)
def _(t, p):
    cohort = prospect_cohort(t, named=False, require_active_staff=False, start="fallback")
    return cohort.select(
        "prospect_id",
        "officer_id",
        F.when(is_.has_priority("PQ"), F.col("start_date")).alias("pq_date"),
        F.when(is_.has_priority("PM"), F.col("start_date")).alias("pm_date"),
    )


@check(
    "scl_safe_ratio",
    """SELECT proposal_id, CASE WHEN coalesce(ask_amt, 0) = 0 THEN 0.0::DOUBLE
    ELSE CAST(granted_amt AS DOUBLE) / CAST(ask_amt AS DOUBLE) END AS granted_of_ask FROM proposal""",
)
def _(t, p):
    ratio = scalars.safe_ratio(F.col("granted_amt"), F.col("ask_amt"))
    return t.proposal.select("proposal_id", ratio.alias("granted_of_ask"))


@check(
    "scl_null_ratio",
    s.with_cohort(
        """SELECT officer_id, count(*) AS size, count(*) FILTER (priority_code = 'PQ') AS pq_size,
        count(*) FILTER (stage_code = 'Q') / nullif(count(*) FILTER (priority_code = 'PQ'), 0) AS ratio
        FROM cohort GROUP BY ALL"""
    ),
)
def _(t, p):
    sizes = officer_portfolio(prospect_cohort(t), t, p)
    ratio = scalars.unless_zero(F.col("pq_size"), F.col("n_q") / F.col("pq_size"))
    return sizes.select("officer_id", F.col("portfolio_size").alias("size"), "pq_size", ratio.alias("ratio"))


@check(
    "scl_difference",
    """SELECT pl.proposal_id, pl.ask_amt, pool.abs_high_capacity_ucdt_asks,
    CAST(pl.ask_amt - pool.abs_high_capacity_ucdt_asks AS DECIMAL(19,2)) AS difference FROM proposal pl
    LEFT JOIN ucdr_prospect_pool pool ON pool.prosp_id = pl.prospect_id AND pool.prim_prosp_ind = 'Y'""",
)
def _(t, p):
    capacity = primary_pool(t).select("prospect_id", "abs_high_capacity_ucdt_asks")
    difference = (F.col("ask_amt") - F.col("abs_high_capacity_ucdt_asks")).alias("difference")
    joined = t.proposal.join(capacity, "prospect_id", "left")
    return joined.select("proposal_id", "ask_amt", "abs_high_capacity_ucdt_asks", difference)


@check("scl_fiscal_year", f"SELECT proposal_id, stop_date, {s.fiscal_year('stop_date')} AS fiscal_year FROM proposal")
def _(t, p):
    return t.proposal.select("proposal_id", "stop_date", scalars.fiscal_year("stop_date", p).alias("fiscal_year"))


_STAFF_TYPES = (
    f"SELECT st.id_number, un.short_desc AS unit, {s.OFFICER_TYPE.format(officer='st.id_number')} AS officer_type "
    "FROM staff st LEFT JOIN tms_unit_code un ON un.unit_code = st.unit_code"
)


@check("scl_do_type", _STAFF_TYPES)
def _(t, p):
    units = t.tms_unit_code.select("unit_code", F.col("short_desc").alias("unit"))
    kind = scalars.officer_type(F.col("unit"), F.col("id_number"), p)
    return t.staff.join(units, "unit_code", "left").select("id_number", "unit", kind.alias("officer_type"))


@check(
    "scl_size_recommended",
    s.with_cohort(
        f"""SELECT officer_id, officer_type, portfolio_size,
        {s.recommended('officer_type', 'portfolio_size')} AS recommended FROM ({s.officer_portfolio()})"""
    ),
)
def _(t, p):
    sizes = officer_portfolio(prospect_cohort(t), t, p)
    flag = scalars.size_recommended(F.col("officer_type"), F.col("portfolio_size"), p)
    return sizes.select("officer_id", "officer_type", "portfolio_size", flag.alias("recommended"))


@check(
    "scl_threshold_flag",
    s.with_cohort(
        f"""SELECT officer_id, CASE WHEN n_q / portfolio_size > 0.25 THEN 'Yes' ELSE 'No' END AS qualification,
        CASE WHEN (n_cu + n_st) / portfolio_size >= 0.5 THEN 'Yes' ELSE 'No' END AS cultivation_stewardship,
        CASE WHEN n_so / portfolio_size >= 0.1 THEN 'Yes' ELSE 'No' END AS solicitation
        FROM ({s.officer_portfolio()})"""
    ),
)
def _(t, p):
    size = F.col("portfolio_size")
    nurtured = F.col("n_cu") + F.col("n_st")
    return officer_portfolio(prospect_cohort(t), t, p).select(
        "officer_id",
        scalars.yes_no(scalars.share(F.col("n_q"), size) > 0.25).alias("qualification"),
        scalars.yes_no(scalars.share(nurtured, size) >= 0.5).alias("cultivation_stewardship"),
        scalars.yes_no(scalars.share(F.col("n_so"), size) >= 0.1).alias("solicitation"),
    )


@check(
    "scl_quartile_label",
    f"""SELECT prospect_id, {s.quartile('ask_made / nullif(proposals, 0)')} AS label FROM (
    SELECT prospect_id, count(*) FILTER (proposal_type LIKE 'MG%' AND {s.within('start_date')}) AS proposals,
    count(*) FILTER (proposal_type LIKE 'MG%' AND {s.within('start_date')}
      AND stage_code IN ('AM', 'DN', 'GC', 'PL', 'ST')) AS ask_made FROM proposal
      WHERE prospect_id IS NOT NULL GROUP BY ALL)""",
)
def _(t, p):
    prospects = t.proposal.select("prospect_id").dropna().distinct()
    counts = prospects.join(prospect_proposals(t, p), "prospect_id", "left")
    label = scalars.quartile_label(scalars.share(F.col("ask_made"), F.col("proposals")))
    return counts.select("prospect_id", label.alias("label"))


@check("scl_concat_dates", f"SELECT id_number, sort || ': ' || {s.RANGE_LABEL} AS label FROM staff")
def _(t, p):
    return t.staff.select("id_number", F.concat_ws(": ", "sort", dates.rolling_label(p)).alias("label"))


@check(
    "scl_constants",
    f"""SELECT id_number, {s.NOW} AS date_pulled, {s.window_text(P.window)} AS date_range,
    {s.window_text(P.om_window)} AS om_date_range FROM staff""",
)
def _(t, p):
    return t.staff.select(
        "id_number",
        dates.now(p).alias("date_pulled"),
        F.lit(window_label(p.window)).alias("date_range"),
        F.lit(window_label(p.om_window)).alias("om_date_range"),
    )


@check(
    "scl_ask_gap_flag",
    s.with_cohort(
        f"""SELECT c.prospect_id, c.officer_id, c.start_date, pool.date_last_mg_ask,
        {s.ask_gap('c.start_date', 'pool.date_last_mg_ask')} AS flag FROM cohort c
        LEFT JOIN ucdr_prospect_pool pool ON pool.prosp_id = c.prospect_id AND pool.prim_prosp_ind = 'Y'""",
        s.MANAGED_FALLBACK,
    ),
)
def _(t, p):
    cohort = prospect_cohort(t, named=False, require_active_staff=False, start="fallback")
    asks = primary_pool(t).select("prospect_id", "date_last_mg_ask")
    flag = scalars.ask_gap_flag(F.col("start_date"), F.col("date_last_mg_ask"), p)
    joined = cohort.join(asks, "prospect_id", "left")
    return joined.select("prospect_id", "officer_id", "start_date", "date_last_mg_ask", flag.alias("flag"))


def assessment_columns(t, p, *columns: str):
    kept = ("prospect_id", "rm_name", "years_as_rm", "visits_any_12m", "visits_rm_12m", "contacts_rm_12m")
    return portfolio_analysis(t, p).select(*kept, *columns)
