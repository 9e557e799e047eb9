"""Cohorts and portfolio sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectus.checks import sqltext as s
from prospectus.checks.registry import check
from prospectus.operators import cohorts, officers
from prospectus.plans.officer_management import om_officer_sizes
from prospectus.sources.staged import STAGED_PARAMS as P


@check("cohort_rm_any_staff", s.MANAGED)
def _(t, p):
    return cohorts.prospect_cohort(t, named=False, require_active_staff=False, start="assigned")


@check("cohort_rm_start_fallback", s.MANAGED_FALLBACK)
def _(t, p):
    return cohorts.prospect_cohort(t, named=False, require_active_staff=False, start="fallback")


@check("cohort_rm_active_staff", s.cohort())
def _(t, p):
    return cohorts.prospect_cohort(t)


@check("cohort_tm", s.cohort("S"))
def _(t, p):
    return cohorts.prospect_cohort(t, "S")


@check("cohort_om", s.OM)
def _(t, p):
    return cohorts.om_cohort(t, p)


PROPOSAL_COHORT = f"""
SELECT DISTINCT pl.proposal_id, pl.prospect_id, pool.sort_name AS prospect_name, asg.priority_code,
  asg.assignment_type, st.id_number AS rm_number, st.sort AS rm_name, pl.proposal_type, pl.active_ind,
  pl.proposal_status_code, sd.short_desc AS proposal_status_desc, pl.stage_code AS current_stage,
  sn.short_desc AS current_stage_desc, pl.start_date, pl.stop_date, {s.fiscal_year('pl.stop_date')} AS fiscal_year,
  pl.proposal_title, pl.original_ask_amt, pl.ask_amt, pl.granted_amt, pl.initial_contribution_date,
  pl.plan_gift_ind, pl.unit_code, pl.expected_date, pool.high_ucdt_or_capacity, pool.abs_high_capacity_ucdt_asks
FROM proposal pl
LEFT JOIN tms_proposal_status sd ON sd.proposal_status_code = pl.proposal_status_code
LEFT JOIN tms_proposal_stage sn ON sn.stage_code = pl.stage_code
LEFT JOIN prospect_entity pe ON pe.prospect_id = pl.prospect_id AND pe.primary_ind = 'Y'
LEFT JOIN ucdr_prospect_pool pool ON pool.id_number = pe.id_number
LEFT JOIN assignment asg ON asg.prospect_id = pl.prospect_id AND asg.assignment_type = 'LM' AND asg.active_ind = 'Y'
LEFT JOIN staff st ON st.id_number = asg.assignment_id_number AND st.active_ind = 'Y'
WHERE starts_with(pl.proposal_type, 'MG')
  AND coalesce(pl.stop_date, {s.stamp(P.stop_from)}) >= {s.stamp(P.stop_from)}
"""


@check("cohort_proposals", PROPOSAL_COHORT)
def _(t, p):
    return cohorts.proposal_cohort(t, p)


@check(
    "officer_portfolio_size_raw",
    """SELECT st.id_number AS officer_id, st.sort AS officer_name, count(*) AS portfolio_size
    FROM assignment asg JOIN staff st ON st.id_number = asg.assignment_id_number
    JOIN prospect pr ON pr.prospect_id = asg.prospect_id
    WHERE asg.assignment_type = 'LM' AND asg.active_ind = 'Y' AND pr.active_ind = 'Y' AND st.staff_type_code = 'DEV'
    GROUP BY ALL""",
)
def _(t, p):
    return officers.portfolio_size_raw(t)


@check("officer_portfolio", s.with_cohort(s.officer_portfolio()))
def _(t, p):
    return officers.officer_portfolio(cohorts.prospect_cohort(t), t, p)


@check(
    "officer_portfolio_om",
    s.with_cohort(
        """SELECT c.officer_id, c.officer_name, count(c.prospect_id) AS portfolio_size,
        (SELECT count(*) FROM cohort q WHERE q.priority_code = 'PQ' AND q.officer_id = c.officer_id) AS pq_size
        FROM cohort c GROUP BY c.officer_id, c.officer_name""",
        s.OM,
    ),
)
def _(t, p):
    return om_officer_sizes(cohorts.om_cohort(t, p))


@check(
    "officer_other_role_size",
    f"SELECT 'LM' AS role, * FROM ({s.role_size('LM')}) UNION ALL SELECT 'S' AS role, * FROM ({s.role_size('S')})",
)
def _(t, p):
    return (
        officers.role_size(t, "LM")
        .withColumn("role", F.lit("LM"))
        .unionByName(officers.role_size(t, "S").withColumn("role", F.lit("S")))
    )


@check("all_assignments", s.with_cohort(s.ALL_ASSIGNMENTS))
def _(t, p):
    return cohorts.all_assignments(t, cohorts.prospect_cohort(t))
