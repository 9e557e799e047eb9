"""Reports and scorecard measures. The check SQL joins row by row and counts the joined rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectus import plans
from prospectus.checks import sqltext as s
from prospectus.checks.aggregates import (
    ADDED,
    FIRST_ASK,
    REMOVED,
    STOPPED,
    VISITS_BY_AUTHOR,
    VISITS_TO_ASK,
    coverage_sql,
    scorecard_counts,
)
from prospectus.checks.cohorts import PROPOSAL_COHORT
from prospectus.checks.published import CAPACITY_STEPS, COUNT_COLUMNS, STAGE_MIX
from prospectus.checks.registry import check, register
from prospectus.checks.scalars import assessment_columns
from prospectus.checks.windows import LEADS
from prospectus.plans.scorecard import scorecards
from prospectus.sources.staged import STAGED_PARAMS as P

OM_STAMP = f"{s.NOW} AS date_pulled, {s.window_text(P.om_window)} AS date_range"

check("report_portfolio_percents", coverage_sql(f", {s.NOW} AS date_pulled, {s.RANGE_LABEL} AS date_range"))(
    lambda t, p: plans.portfolio_percents(t, p)
)
check("report_prospects_added", ADDED.format(role="LM"))(lambda t, p: plans.prospects_added(t, p))
check("report_prospects_dropped", STOPPED.format(role="S"))(lambda t, p: plans.prospects_dropped(t, p))
check(
    "report_dropped_nn_dq",
    f"""SELECT count(*) AS dropped_nn_dq FROM (SELECT DISTINCT pr.prospect_id FROM prospect pr
    LEFT JOIN assignment asg ON asg.prospect_id = pr.prospect_id AND asg.assignment_type = 'LM'
    WHERE {s.within('pr.stop_date')} AND EXISTS (SELECT 1 FROM contact_report r
      WHERE r.prospect_id = pr.prospect_id AND r.contact_outcome IN ('NN', 'DQ')))""",
)(lambda t, p: plans.dropped_nn_dq(t, p))
check("report_om_visits", f"SELECT *, {OM_STAMP} FROM ({VISITS_BY_AUTHOR})")(lambda t, p: plans.om_visits(t, p))
check(
    "report_om_proposals",
    s.with_cohort(
        f"""SELECT pl.proposal_id, pl.prospect_id, pl.start_date, pl.stop_date, pl.active_ind,
        pl.proposal_status_code, pl.stage_code, pl.original_ask_amt, pl.ask_amt, pl.anticipated_amt, pl.granted_amt,
        pool.abs_high_capacity_ucdt_asks, pool.abs_high_capacity_ucdt_ask_lvl,
        CAST(pl.ask_amt - pool.abs_high_capacity_ucdt_asks AS DECIMAL(19,2)) AS ask_minus_capacity,
        pl.initial_contribution_date AS ask_date, pl.expected_date AS close_date,
        {s.years2('pl.initial_contribution_date', 'pl.expected_date')} AS years_to_close, {OM_STAMP}
        FROM cohort c JOIN proposal pl ON pl.prospect_id = c.prospect_id
        LEFT JOIN ucdr_prospect_pool pool ON pool.prosp_id = pl.prospect_id AND pool.prim_prosp_ind = 'Y'
        WHERE pl.proposal_type LIKE 'MG%' AND {s.within('pl.start_date', P.om_window)}""",
        s.OM,
    ),
)(lambda t, p: plans.om_proposals(t, p))
check(
    "report_om_prospects",
    s.with_cohort(
        f"""SELECT c.prospect_id, c.officer_name AS rm_name, c.start_date AS assignment_start_date, f.ask_date,
        v.visits AS visits_to_ask, {s.years2('c.start_date', s.NOW)} AS years_in_portfolio,
        {s.years2('c.start_date', 'f.ask_date')} AS years_to_ask,
        (SELECT count(*) FROM cohort q WHERE q.officer_id = c.officer_id) AS portfolio_size,
        rm.total_removed, {OM_STAMP}
        FROM cohort c LEFT JOIN ({FIRST_ASK}) f ON f.prospect_id = c.prospect_id
        LEFT JOIN ({VISITS_TO_ASK}) v ON v.prospect_id = c.prospect_id
        LEFT JOIN ({REMOVED}) rm ON rm.officer_name = c.officer_name""",
        s.OM,
    ),
)(lambda t, p: plans.om_prospects(t, p))


def _guarded(part: str, whole: str) -> str:
    ratio = f"CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE)"
    return f"CASE WHEN coalesce({whole}, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE {ratio} END"


_STAGE_COLUMNS = ", ".join(f"sd.days_{c.lower()}" for c in s.STAGE_CODES)
check(
    "report_proposal_stats",
    f"""SELECT q.proposal_id, q.proposal_type, q.proposal_title, q.prospect_id, q.prospect_name, ld.lead_id,
    ld.lead_name, q.rm_number, q.rm_name, q.priority_code, q.assignment_type, q.active_ind,
    q.proposal_status_desc, q.current_stage_desc, q.start_date, q.stop_date, q.fiscal_year, q.original_ask_amt,
    q.ask_amt, q.granted_amt, {_guarded('q.granted_amt', 'q.ask_amt')} AS granted_of_ask, q.high_ucdt_or_capacity,
    {_guarded('q.ask_amt', 'q.high_ucdt_or_capacity')} AS ask_of_capacity, q.abs_high_capacity_ucdt_asks,
    {_guarded('q.ask_amt', 'q.abs_high_capacity_ucdt_asks')} AS ask_of_abs_capacity,
    q.initial_contribution_date AS ask_date, q.expected_date, q.plan_gift_ind, q.unit_code, {_STAGE_COLUMNS},
    {s.NOW} AS date_run FROM ({PROPOSAL_COHORT}) q LEFT JOIN ({LEADS}) ld ON ld.proposal_id = q.proposal_id
    LEFT JOIN ({s.STAGE_DAYS}) sd ON sd.proposal_id = q.proposal_id""",
)(lambda t, p: plans.proposal_stats(t, p))


def _sheet_counts(by_author: bool, rolling: bool) -> str:
    keys = "c.prospect_id, r.author_id_number" if by_author else "c.prospect_id"
    own = "AND r.author_id_number = c.officer_id" if by_author else ""
    dated = f"AND r.contact_date >= {s.ROLLING_EARLY} AND r.contact_date <= {s.NOW}" if rolling else ""
    return (
        f"SELECT {keys}, count(r.report_id) AS contacts, count(r.report_id) FILTER ({s.visit('r')}) AS visits, "
        f"max(CASE WHEN {s.visit('r')} THEN r.contact_date END) AS latest FROM cohort c LEFT JOIN contact_report r "
        f"ON r.prospect_id = c.prospect_id AND {s.contact('r')} {own} {dated} GROUP BY ALL"
    )


# The rules as a table of tests, the first of which that holds decides.
_CAPABLE = "pool.abs_high_capacity_ucdt_asks >= 50000"
_RULES = [
    ("pool.pers_org_ind = 'O'", None, None),
    ("held < 0.5", "ORANGE", "In Portfolio < 6 months"),
    ("pool.abs_high_capacity_ucdt_asks < 50000 AND pool.lifetime_giving_devel < 50000", "RED",
     "Highest MG Capacity < $50k and Lifetime Giving < $50k"),
    ("pool.abs_high_capacity_ucdt_asks < 100000 AND coalesce(pool.lifetime_giving_devel, 0) = 0 AND nr.visits = 0",
     "RED", "Highest MG Capacity < $100k and No Visit By Any DO in 12 Months and No Giving Ever"),
    (f"{_CAPABLE} AND coalesce(wr.visits, 0) = 0 AND held >= 2", "YELLOW",
     "Highest MG Capacity > $50k and No F2F By RM and Years As RM > 2yrs"),
    (f"{_CAPABLE} AND ts.full_desc <> 'Active Solicitation' AND held >= 1 AND g.date_of_record >= {s.ROLLING} "
     f"AND g.date_of_record <= {s.NOW}", "YELLOW",
     "Highest MG Capacity > $50k and Any Gift Within Past 12 Months and Not Active Solicitation"),
    (f"{_CAPABLE} AND wr.contacts > 0", "GREEN", "Highest MG Capacity > $50k and Contact By RM in 12 Months"),
    (f"{_CAPABLE} AND nr.visits > 0", "GREEN", "Highest MG Capacity > $50k and Any F2F in 12 Months"),
    ("held >= 1 AND w.contacts = 0", "YELLOW2", "Not Red, Yellow, or Green and RM > 1yr and No Contact By RM ever"),
]


def _decide(values: list[str | None]) -> str:
    chain = " ".join(
        f"WHEN {test} THEN {'NULL' if v is None else repr(v)}" for (test, _, _), v in zip(_RULES, values)
    )
    held = s.years2("c.start_date", s.NOW)
    return f"CASE {chain} END".replace("held ", f"{held} ")


def _newest_gift(columns: str, test: str, tie: str = "") -> str:
    return (
        f"SELECT id_number, {columns} FROM ucdr_giving WHERE giving_ind IN ('P', 'G') {test} QUALIFY row_number() OVER "
        f"(PARTITION BY id_number ORDER BY date_of_record DESC NULLS FIRST{tie}) = 1"
    )


_POOL_COLUMNS = (
    "pers_org_ind", "pref_mail_name", "age", "spouse_age", "record_type_code", "spouse_record_type_code",
    "home_business_state", "home_business_county", "high_act_ask_plan", "highest_active_ask",
    "abs_high_capacity_ucdt_asks", "abs_high_capacity_ucdt_ask_lvl", "high_ucdt_or_capacity", "lifetime_giving_devel",
    "first_fy_gift", "first_fy_major_gift", "last_fy_gift", "last_fy_major_gift", "nbr_giving_yrs", "nbr_of_gifts",
    "gift_in_each_of_last_3_fy", "last_contact_date", "last_contact_author", "last_contact_attempt_auth",
    "date_last_face_2_face", "last_face2face_author", "date_last_mg_ask", "last_mg_ask_author",
)

ANALYSIS = s.with_cohort(
    f"""SELECT c.prospect_id, st.sort AS rm_name, un.full_desc AS rm_area, pool.id_number AS entity_id,
    pool.sort_name AS prospect_name, pool.last_contact_attempt AS last_contact_attempt_date,
    {', '.join(f'pool.{c}' for c in _POOL_COLUMNS)},
    CASE c.priority_code WHEN 'PQ' THEN c.start_date END AS pq_assign_date,
    CASE c.priority_code WHEN 'PM' THEN c.start_date END AS pm_assign_date,
    (SELECT max(pl.initial_contribution_date) FROM proposal pl WHERE pl.prospect_id = c.prospect_id
       AND pl.ask_amt = pool.high_act_ask_plan AND pl.stage_code = 'RB' AND pl.active_ind = 'Y'
       AND pl.proposal_type LIKE 'MG%') AS high_act_ask_plan_date,
    {s.ask_gap('c.start_date', 'pool.date_last_mg_ask')} AS rm_18_months_no_ask,
    af.prim_amt AS af_last_amt, af.date_of_record AS af_last_date, ts.full_desc AS prospect_stage,
    mg.contact_outcome AS qualified_code, mg.contact_date AS qualified_date,
    wr.contacts AS contacts_rm_12m, w.contacts AS contacts_rm, wr.visits AS visits_rm_12m, w.visits AS visits_rm,
    w.latest AS latest_visit_rm, nr.contacts AS contacts_any_12m, n.contacts AS contacts_any,
    nr.visits AS visits_any_12m, n.visits AS visits_any, n.latest AS latest_visit_any,
    {s.years2('c.start_date', s.NOW)} AS years_as_rm, g.date_of_record AS last_gift_date,
    {_decide([code for _, code, _ in _RULES])} AS assessment,
    {_decide([reason for _, _, reason in _RULES])} AS assessment_reason,
    {s.NOW} AS date_pulled, {s.RANGE_LABEL} AS date_range
    FROM cohort c LEFT JOIN ucdr_prospect_pool pool ON pool.prosp_id = c.prospect_id AND pool.prim_prosp_ind = 'Y'
    LEFT JOIN staff st ON st.id_number = c.officer_id LEFT JOIN tms_unit_code un ON un.unit_code = st.unit_code
    LEFT JOIN tms_stage ts ON ts.stage_code = c.stage_code
    LEFT JOIN ({_sheet_counts(True, False)}) w ON w.prospect_id = c.prospect_id
    LEFT JOIN ({_sheet_counts(True, True)}) wr ON wr.prospect_id = c.prospect_id
    LEFT JOIN ({_sheet_counts(False, False)}) n ON n.prospect_id = c.prospect_id
    LEFT JOIN ({_sheet_counts(False, True)}) nr ON nr.prospect_id = c.prospect_id
    LEFT JOIN ({_newest_gift('date_of_record', '')}) g ON g.id_number = pool.id_number
    LEFT JOIN ({_newest_gift('date_of_record, prim_amt', "AND prog_hier_num = '1'", ', prim_amt DESC NULLS FIRST')}) af
      ON af.id_number = pool.id_number
    LEFT JOIN (SELECT prospect_id, contact_outcome, contact_date FROM contact_report
               WHERE contact_outcome NOT IN ('DU', 'QO', ' ') QUALIFY row_number() OVER (PARTITION BY prospect_id
               ORDER BY contact_date DESC NULLS FIRST, contact_outcome DESC NULLS FIRST) = 1) mg
      ON mg.prospect_id = c.prospect_id""",
    s.MANAGED_FALLBACK,
)
check("report_portfolio_analysis", ANALYSIS)(lambda t, p: plans.portfolio_analysis(t, p))


def _analysis_columns(*columns: str) -> str:
    return f"SELECT {', '.join(columns)} FROM ({ANALYSIS})"


_ASSESSED = ("prospect_id", "rm_name", "years_as_rm", "visits_any_12m", "visits_rm_12m", "contacts_rm_12m")
check("scl_assessment", _analysis_columns(*_ASSESSED, "assessment"))(
    lambda t, p: assessment_columns(t, p, "assessment")
)
check("scl_assessment_reason", _analysis_columns(*_ASSESSED, "assessment_reason"))(
    lambda t, p: assessment_columns(t, p, "assessment_reason")
)


def scorecard_sql(atype: str) -> str:
    """The scorecard with every join spelled out: officer counts run over the joined rows."""
    team = atype == "S"
    tests = {
        "ask_major_by_officer": "own.ask > 0",
        "ask_major_any": "anyone.ask > 0",
        "ask_any_by_officer": "own.ask_or_special > 0",
        "ask_special_by_officer": "own.special > 0",
        "ask_any_any": "anyone.ask_or_special > 0",
        "ask_special_any": "anyone.special > 0",
        "contacted_by_officer": "own.contacts > 0",
        "visited_by_officer": "own.visits > 0",
        "visited_twice_by_officer": "own.visits > 1",
        "contacted_any": "anyone.contacts > 0",
        "visited_any": "anyone.visits > 0",
        **{f"rated_lt_{k}": f"pool.abs_high_capacity_ucdt_asks < {v}" for k, v in CAPACITY_STEPS.items()},
        **{f"rated_ge_{k}": f"pool.abs_high_capacity_ucdt_asks >= {v}" for k, v in CAPACITY_STEPS.items()},
        "gave": "gv.total_giving <> 0",
        "documented_strategy": "own.strategy > 0",
        "dq_nn_nr_reports": "own.dq_nn_nr > 0",
        "qualified_reports": "own.qu > 0",
        "pq_visited_rows": "pq.visits > 0",
        "pq_qualified_rows": "pq.qualified > 0",
        "pm_visited_rows": "pm.visits > 0",
        "pm_qualified_rows": "pm.qualified > 0",
        "not_zero_contacts": "own.contacts IS DISTINCT FROM 0",
        "not_zero_visits": "own.visits IS DISTINCT FROM 0",
        "not_zero_asks": "anyone.ask IS DISTINCT FROM 0",
        "not_zero_specials": "own.special IS DISTINCT FROM 0",
    }
    sums = {
        "proposals": "proposals",
        "proposals_ask_made": "ask_made",
        "proposals_dropped_before_ask": "dropped_before_ask",
        "proposals_closed": "closed",
    }
    own_join = "own.prospect_id = c.prospect_id" + (" AND own.author_id = c.officer_id" if team else "")
    activity = {k: s.OWN_TESTS[k] for k in ("visits", "qualified")}
    counted = f"""SELECT c.officer_id, c.officer_name,
      {', '.join(f'count(*) FILTER ({test}) AS {name}' for name, test in tests.items())},
      {', '.join(f'CAST(sum(pp.{column}) AS BIGINT) AS {name}' for name, column in sums.items())}
      FROM cohort c
      LEFT JOIN ucdr_prospect_pool pool ON pool.prosp_id = c.prospect_id AND pool.prim_prosp_ind = 'Y'
      LEFT JOIN ({s.own_activity(s.OWN_TESTS)}) own ON {own_join}
      LEFT JOIN ({s.any_activity(s.ANY_TESTS)}) anyone ON anyone.prospect_id = c.prospect_id
      LEFT JOIN ({s.own_activity(activity, "c.priority_code = 'PQ'")}) pq ON pq.prospect_id = c.prospect_id
      LEFT JOIN ({s.own_activity(activity, "c.priority_code = 'PM'")}) pm ON pm.prospect_id = c.prospect_id
      LEFT JOIN ({s.GIVING}) gv ON gv.prospect_id = c.prospect_id
      LEFT JOIN ({s.PROPOSALS}) pp ON pp.prospect_id = c.prospect_id
      GROUP BY c.officer_id, c.officer_name"""

    def pct(name: str, value: str | None = None, whole: str = "o.portfolio_size") -> str:
        return f"{value or 'm.' + name} / {whole} AS pct_{name}"

    def aged(code: str, source: str) -> str:
        return (
            f"(SELECT count(*) FROM ({source}) a WHERE a.officer_id = o.officer_id AND a.stage_code = '{code}' "
            f"AND {s.years('a.stage_date', s.NOW)} >= 1)"
        )

    columns = ["o.officer_name", "o.officer_id", "o.office", "o.unit", "o.officer_type", "o.years_as_officer"]
    other = f"(SELECT role_size FROM ({s.role_size('LM' if team else 'S')}) x WHERE x.officer_id = o.officer_id)"
    sizes = (other, "o.portfolio_size") if team else ("o.portfolio_size", other)
    columns += [f"{sizes[0]} AS portfolio_size", f"{sizes[1]} AS team_member_size"]
    columns += ["o.n_st + o.n_cu + o.n_so AS total_qualified", "o.n_q AS total_to_be_qualified"]
    plain = ("dq_nn_nr_reports", "qualified_reports")
    for name in tests:
        if name.endswith("_rows") or name.startswith("not_zero"):
            continue
        columns.append(f"m.{name}")
        if name not in plain:
            columns.append(pct(name))
    columns.append(
        f"(SELECT count(*) FROM ({s.entity_visits(not team)}) v WHERE v.officer_id = o.officer_id) AS outside_entities"
    )
    codes = {"n_q": "Q", "n_cu": "CU", "n_so": "SO"}
    for name, (count, has_age) in STAGE_MIX.items():
        columns += [f"o.{count} AS {name}", pct(name, f"o.{count}")]
        if has_age:
            columns.append(pct(f"{name}_1yr", aged(codes[count], s.TIME_AT_STAGE)))
    columns += [f"m.{name}" for name in sums]
    columns += [pct(name, whole="m.proposals") for name in list(sums)[1:]]
    columns += [
        pct("at_ask_planned_1yr", aged("RB", s.TIME_AT_PROPOSAL_STAGE), "m.proposals"),
        pct("at_ask_made_1yr", aged("AM", s.TIME_AT_PROPOSAL_STAGE), "m.proposals"),
        "CAST(floor(o.years_as_officer) AS BIGINT) AS years_floor",
        f"{s.recommended('o.officer_type', 'o.portfolio_size')} AS size_recommended",
    ]
    flags = {
        "rated_100k_over_half": "m.rated_ge_100k / o.portfolio_size > 0.5",
        "rated_lt_50k_over_quarter": "m.rated_lt_50k / o.portfolio_size > 0.25",
        "qualification_over_quarter": "o.n_q / o.portfolio_size > 0.25",
        "cultivation_stewardship_half": "(o.n_cu + o.n_st) / o.portfolio_size >= 0.5",
        "solicitation_tenth": "o.n_so / o.portfolio_size >= 0.1",
    }
    columns += [f"CASE WHEN {test} THEN 'Yes' ELSE 'No' END AS {name}" for name, test in flags.items()]
    labels = {
        "contact_quartile": "m.not_zero_contacts / o.portfolio_size",
        "visit_quartile": "m.not_zero_visits / o.portfolio_size",
        "ask_major_any_quartile": "m.not_zero_asks / o.portfolio_size",
        "ask_special_quartile": "m.not_zero_specials / o.portfolio_size",
        "ask_made_quartile": "m.proposals_ask_made / m.proposals",
        "closed_quartile": "m.proposals_closed / m.proposals",
    }
    columns += [f"{s.quartile(ratio)} AS {name}" for name, ratio in labels.items()]
    for k in ("pq", "pm"):
        columns.append(f"o.{k}_size")
        for kind in ("visited", "qualified"):
            columns += [
                f"CASE WHEN o.{k}_size > 0 THEN m.{k}_{kind}_rows END AS {k}_{kind}",
                f"m.{k}_{kind}_rows / nullif(o.{k}_size, 0) AS pct_{k}_{kind}",
            ]
    columns += [f"{s.NOW} AS date_pulled", f"{s.window_text(P.window)} AS date_range"]
    return s.with_cohort(
        f"SELECT {', '.join(columns)} FROM ({s.officer_portfolio()}) o JOIN ({counted}) m ON m.officer_id = o.officer_id",
        s.cohort(atype),
    )


SCORECARD = {atype: scorecard_sql(atype) for atype in ("LM", "S")}

check("report_scorecard_rm", SCORECARD["LM"])(lambda t, p: plans.officer_scorecard(t, p, "LM"))
check("report_scorecard_tm", SCORECARD["S"])(lambda t, p: plans.officer_scorecard(t, p, "S"))


def _both_roles(*columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{atype}' AS role, officer_id, {', '.join(columns)} FROM ({sql})" for atype, sql in SCORECARD.items()
    )


check("agg_scorecard", _both_roles(*COUNT_COLUMNS))(scorecard_counts)


def _shares(*names: str) -> tuple[str, ...]:
    return tuple(c for name in names for c in (name, f"pct_{name}"))


# Scorecard measures by topic; each key covers both roles.
MEASURES = {
    "ms_identity": (
        "officer_name", "office", "unit", "officer_type", "years_as_officer", "portfolio_size", "team_member_size"),
    "ms_qualified": ("total_qualified", "total_to_be_qualified"),
    "ms_asks": _shares("ask_major_by_officer", "ask_major_any", "ask_any_by_officer", "ask_special_by_officer",
                       "ask_any_any", "ask_special_any"),
    "ms_contacts_visits": _shares("contacted_by_officer", "visited_by_officer", "visited_twice_by_officer",
                                  "contacted_any", "visited_any"),
    "ms_outside": ("outside_entities",),
    "ms_capacity_bands": _shares(*[f"rated_{side}_{step}" for step in CAPACITY_STEPS for side in ("lt", "ge")]),
    "ms_gave": _shares("gave"),
    "ms_stage_mix": tuple(
        c for name, (_, aged) in STAGE_MIX.items() for c in (*_shares(name), *([f"pct_{name}_1yr"] if aged else []))),
    "ms_strategy_outcomes": (*_shares("documented_strategy"), "dq_nn_nr_reports", "qualified_reports"),
    "ms_proposals": ("proposals", *_shares("proposals_ask_made", "proposals_dropped_before_ask", "proposals_closed"),
                     "pct_at_ask_planned_1yr", "pct_at_ask_made_1yr"),
    "ms_years_floor": ("years_floor",),
    "ms_size_flag": ("officer_type", "portfolio_size", "team_member_size", "size_recommended"),
    "ms_ratio_flags": ("rated_100k_over_half", "rated_lt_50k_over_quarter", "qualification_over_quarter",
                       "cultivation_stewardship_half", "solicitation_tenth"),
    "ms_quartiles": ("contact_quartile", "visit_quartile", "ask_major_any_quartile", "ask_special_quartile",
                     "ask_made_quartile", "closed_quartile"),
    "ms_pq": ("pq_size", *_shares("pq_visited", "pq_qualified")),
    "ms_pm": ("pm_size", *_shares("pm_visited", "pm_qualified")),
    "ms_stamp": ("date_pulled", "date_range"),
}


def _measure(columns: tuple[str, ...]):
    return lambda t, p: scorecards(t, p, *columns)


for _key, _columns in MEASURES.items():
    register(_key, _measure(_columns), _both_roles(*_columns))
