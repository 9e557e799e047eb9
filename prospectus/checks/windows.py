"""Latest-row windows, sorts and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectus.checks import sqltext as s
from prospectus.checks.cohorts import PROPOSAL_COHORT
from prospectus.checks.published import STAGE_COUNTS
from prospectus.checks.registry import check
from prospectus.operators import contacts, giving, officers, proposals, stages
from prospectus.operators.cohorts import listed_proposals, prospect_cohort
from prospectus.operators.ranking import latest_by


def _managed(t):
    return prospect_cohort(t, named=False, require_active_staff=False, start="fallback")


def _cohort_entities(t):
    return giving.primary_pool(t).join(_managed(t), "prospect_id", "left_semi").select("id_number").distinct()


def _newest_gift(columns: str, order: str, test: str) -> str:
    return s.with_cohort(
        f"""SELECT id_number, {columns} FROM (SELECT g.*, row_number() OVER (PARTITION BY g.id_number ORDER BY {order})
        AS place FROM cohort c JOIN ucdr_prospect_pool pool ON pool.prosp_id = c.prospect_id
        AND pool.prim_prosp_ind = 'Y' JOIN ucdr_giving g ON g.id_number = pool.id_number WHERE {test})
        WHERE place = 1""",
        s.MANAGED_FALLBACK,
    )


@check(
    "win_last_gift",
    _newest_gift("date_of_record AS last_gift_date", "g.date_of_record DESC NULLS FIRST", "g.giving_ind IN ('P', 'G')"),
)
def _(t, p):
    return giving.last_gift(t).join(_cohort_entities(t), "id_number", "left_semi")


@check(
    "win_last_annual_fund",
    _newest_gift(
        "date_of_record AS af_last_date, prim_amt AS af_last_amt",
        "g.date_of_record DESC NULLS FIRST, g.prim_amt DESC NULLS FIRST",
        "g.giving_ind IN ('P', 'G') AND g.prog_hier_num = '1'",
    ),
)
def _(t, p):
    return giving.last_annual_fund_gift(t).join(_cohort_entities(t), "id_number", "left_semi")


@check(
    "win_last_qualification",
    s.with_cohort(
        """SELECT prospect_id, contact_outcome, contact_date FROM (SELECT r.*, row_number() OVER (
        PARTITION BY r.prospect_id ORDER BY r.contact_date DESC NULLS FIRST, r.contact_outcome DESC NULLS FIRST)
        AS place FROM cohort c JOIN contact_report r ON r.prospect_id = c.prospect_id
        WHERE r.contact_outcome NOT IN ('DU', 'QO', ' ')) WHERE place = 1""",
        s.MANAGED_FALLBACK,
    ),
)
def _(t, p):
    return contacts.last_qualification(t).join(_managed(t), "prospect_id", "left_semi")


LEADS = """
SELECT proposal_id, lead_id, st.sort AS lead_name FROM (
  SELECT asg.proposal_id, asg.assignment_id_number AS lead_id, row_number() OVER (PARTITION BY asg.proposal_id
         ORDER BY asg.start_date DESC NULLS FIRST, asg.assignment_id_number DESC NULLS FIRST) AS place
  FROM assignment asg WHERE asg.assignment_type = 'SL' AND asg.proposal_id IS NOT NULL) lead
LEFT JOIN staff st ON st.id_number = lead_id WHERE place = 1
"""


@check(
    "win_lead_solicitor",
    f"SELECT * FROM ({LEADS}) WHERE proposal_id IN (SELECT proposal_id FROM ({PROPOSAL_COHORT}))",
)
def _(t, p):
    return proposals.lead_solicitors(t).join(listed_proposals(t, p), "proposal_id", "left_semi")


@check("win_next_stage_date", f"SELECT proposal_id, stage_code, stage_date, next_date, count(*) AS entries "
       f"FROM ({s.STAGE_SPANS}) GROUP BY ALL")
def _(t, p):
    return stages.proposal_stage_intervals(t)


@check(
    "win_time_at_stage",
    s.with_cohort(f"SELECT *, {s.years('stage_date', s.NOW)} AS years FROM ({s.TIME_AT_STAGE})"),
)
def _(t, p):
    return stages.time_at_stage(prospect_cohort(t), t, p)


@check(
    "win_time_at_stage_proposal",
    s.with_cohort(f"SELECT *, {s.years('stage_date', s.NOW)} AS years FROM ({s.TIME_AT_PROPOSAL_STAGE})"),
)
def _(t, p):
    return stages.time_at_proposal_stage(prospect_cohort(t), t, p)


@check(
    "srt_report",
    s.with_cohort("SELECT officer_name, officer_id, count(*) AS portfolio_size FROM cohort GROUP BY ALL ORDER BY 1"),
)
def _(t, p):
    sizes = officers.officer_counts(prospect_cohort(t)).select("officer_name", "officer_id", "portfolio_size")
    return sizes.orderBy(F.col("officer_name").asc_nulls_last())


@check(
    "srt_top1_per_key",
    """SELECT prospect_id, proposal_id, stage_code, stage_date FROM (SELECT sg.*, row_number() OVER (
    PARTITION BY prospect_id ORDER BY date_added DESC NULLS FIRST, proposal_id DESC NULLS FIRST,
    stage_code DESC NULLS FIRST, stage_date DESC NULLS FIRST) AS place FROM stage sg
    WHERE prospect_id IS NOT NULL) WHERE place = 1""",
)
def _(t, p):
    newest = latest_by(t.stage, ["prospect_id"], "date_added", ["proposal_id", "stage_code", "stage_date"])
    return newest.drop("date_added")


def _officer_scalar(test: str, source: str = "cohort") -> str:
    return f"(SELECT count(*) FROM {source} q WHERE q.officer_id = o.officer_id AND {test})"


_STAGE_COUNTS = ", ".join(
    f"{_officer_scalar(f'''q.stage_code = '{code}' ''')} AS {name}" for code, name in STAGE_COUNTS.items()
)


@check(
    "sub_officer_counts",
    s.with_cohort(
        f"""SELECT o.officer_id, o.officer_name, {_officer_scalar('TRUE')} AS portfolio_size,
        {_officer_scalar("q.priority_code = 'PQ'")} AS pq_size, {_officer_scalar("q.priority_code = 'PM'")} AS pm_size,
        {_STAGE_COUNTS} FROM (SELECT DISTINCT officer_id, officer_name FROM cohort) o"""
    ),
)
def _(t, p):
    return officers.officer_counts(prospect_cohort(t))


def _aged(code: str, source: str) -> str:
    return _officer_scalar(f"q.stage_code = '{code}' AND {s.years('q.stage_date', s.NOW)} >= 1", f"({source})")


_AGED = (("n_q_1y", "Q", s.TIME_AT_STAGE), ("n_cu_1y", "CU", s.TIME_AT_STAGE), ("n_so_1y", "SO", s.TIME_AT_STAGE),
         ("n_rb_1y", "RB", s.TIME_AT_PROPOSAL_STAGE), ("n_am_1y", "AM", s.TIME_AT_PROPOSAL_STAGE))


@check(
    "sub_stage_age_counts",
    s.with_cohort(
        "SELECT o.officer_id, " + ", ".join(f"{_aged(code, source)} AS {name}" for name, code, source in _AGED)
        + " FROM (SELECT DISTINCT officer_id FROM cohort) o"
    ),
)
def _(t, p):
    cohort = prospect_cohort(t)
    counted = (
        cohort.select("officer_id")
        .distinct()
        .join(officers.stage_age_counts(cohort, t, p), "officer_id", "left")
        .join(officers.proposal_age_counts(cohort, t, p), "officer_id", "left")
    )
    return counted.fillna(0)


@check(
    "sub_max_ask_date",
    s.with_cohort(
        """SELECT c.prospect_id, c.officer_id, c.priority_code, pool.high_act_ask_plan,
        (SELECT max(pl.initial_contribution_date) FROM proposal pl WHERE pl.prospect_id = c.prospect_id
           AND pl.ask_amt = pool.high_act_ask_plan AND pl.stage_code = 'RB' AND pl.active_ind = 'Y'
           AND starts_with(pl.proposal_type, 'MG')) AS planned_ask_date
        FROM cohort c LEFT JOIN ucdr_prospect_pool pool ON pool.prosp_id = c.prospect_id
          AND pool.prim_prosp_ind = 'Y'"""
    ),
)
def _(t, p):
    pool = giving.primary_pool(t).select("prospect_id", "high_act_ask_plan")
    planned = proposals.max_planned_ask_date(t).withColumnRenamed("ask_amt", "high_act_ask_plan")
    return (
        prospect_cohort(t)
        .select("prospect_id", "officer_id", "priority_code")
        .join(pool.join(planned, ["prospect_id", "high_act_ask_plan"], "left"), "prospect_id", "left")
    )


@check("sub_stage_day_lookup", s.STAGE_DAYS)
def _(t, p):
    return stages.stage_days(t, p)


@check(
    "sub_next_date",
    f"""SELECT proposal_id, stage_date, next_date, count(*) AS entries FROM ({s.STAGE_SPANS})
    WHERE proposal_id IN (SELECT proposal_id FROM ({PROPOSAL_COHORT})) GROUP BY ALL""",
)
def _(t, p):
    spans = stages.proposal_stage_intervals(t, listed_proposals(t, p))
    return spans.groupBy("proposal_id", "stage_date", "next_date").agg(F.sum("entries").alias("entries"))


def _entity_counts(atype: str, anti: bool) -> str:
    body = (
        f"SELECT '{atype}' AS role, o.officer_id, (SELECT count(*) FROM ({s.entity_visits(anti)}) v "
        "WHERE v.officer_id = o.officer_id) AS entities FROM (SELECT DISTINCT officer_id FROM cohort) o"
    )
    return f"SELECT * FROM ({s.with_cohort(body, s.cohort(atype))})"


@check("sub_outside_entities", f"{_entity_counts('LM', True)} UNION ALL {_entity_counts('S', False)}")
def _(t, p):
    def counted(atype, anti):
        cohort = prospect_cohort(t, atype)
        officers_ = cohort.select(F.lit(atype).alias("role"), "officer_id").distinct()
        entities = contacts.outside_entities(cohort, t, p, anti)
        return officers_.join(entities, "officer_id", "left").select(
            "role", "officer_id", F.coalesce("entities", F.lit(0)).alias("entities")
        )

    return counted("LM", True).unionByName(counted("S", False))
