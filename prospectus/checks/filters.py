"""Row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectus.checks import sqltext as s
from prospectus.checks.registry import check
from prospectus.functions import predicates as is_
from prospectus.functions.dates import ts
from prospectus.sources.staged import STAGED_PARAMS as P

_REPORT = ("report_id", "prospect_id", "author_id_number", "contact_type", "contact_date")
_REPORT_SQL = f"SELECT {', '.join(_REPORT)} FROM contact_report r WHERE "


@check(
    "flt_active",
    """SELECT 'prospect' AS kind, active_ind, count(*) AS n FROM prospect WHERE active_ind = 'Y' GROUP BY ALL
    UNION ALL SELECT 'staff', active_ind, count(*) FROM staff WHERE active_ind = 'Y' GROUP BY ALL
    UNION ALL SELECT 'assignment', active_ind, count(*) FROM assignment GROUP BY ALL
    UNION ALL SELECT 'proposal', active_ind, count(*) FROM proposal WHERE active_ind = 'Y' GROUP BY ALL""",
)
def _(t, p):
    ended = t.assignment.where(is_.is_assignment("LM", "S", "SL", active=False))
    parts = [
        ("prospect", t.prospect.where(is_.is_active())),
        ("staff", t.staff.where(is_.is_active())),
        ("assignment", t.assignment.where(is_.is_active())),
        ("assignment", ended),
        ("proposal", t.proposal.where(is_.is_active())),
    ]
    counted = [
        df.groupBy("active_ind").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "active_ind", "n")
        for kind, df in parts
    ]
    first, *rest = counted
    for part in rest:
        first = first.unionByName(part)
    return first


@check("flt_visit", _REPORT_SQL + s.visit("r"))
def _(t, p):
    return t.contact_report.where(is_.is_visit()).select(*_REPORT)


@check("flt_contact", _REPORT_SQL + s.contact("r"))
def _(t, p):
    return t.contact_report.where(is_.is_contact()).select(*_REPORT)


@check(
    "flt_ask",
    f"""SELECT report_id, contact_purpose_code, contact_type, {s.purpose('r', 'A')} AS ask,
    {s.purpose('r', 'B')} AS special FROM contact_report r WHERE {s.purpose('r', 'A', 'B')}""",
)
def _(t, p):
    return t.contact_report.where(is_.is_ask_or_special()).select(
        "report_id",
        "contact_purpose_code",
        "contact_type",
        is_.is_ask().alias("ask"),
        is_.is_special().alias("special"),
    )


@check("flt_strategy", _REPORT_SQL + "r.contact_type = 'S'")
def _(t, p):
    return t.contact_report.where(is_.is_strategy()).select(*_REPORT)


@check(
    "flt_outcome",
    """SELECT contact_outcome, count(*) FILTER (contact_outcome IN ('DD', 'NN', 'NR')) AS unfavourable,
    count(*) FILTER (contact_outcome = 'QU') AS qu, count(*) FILTER (contact_outcome <> ' ') AS with_outcome,
    count(*) FILTER (contact_outcome NOT IN ('DU', 'QO', ' ')) AS qualifying,
    count(*) FILTER (contact_outcome IN ('NN', 'DQ')) AS turned_down FROM contact_report GROUP BY ALL""",
)
def _(t, p):
    return t.contact_report.groupBy("contact_outcome").agg(
        F.count_if(is_.outcome_in(*is_.UNFAVOURABLE)).alias("unfavourable"),
        F.count_if(is_.outcome_in("QU")).alias("qu"),
        F.count_if(is_.has_outcome()).alias("with_outcome"),
        F.count_if(is_.is_qualification()).alias("qualifying"),
        F.count_if(is_.outcome_in(*is_.DROPPED_OUTCOMES)).alias("turned_down"),
    )


@check("flt_fixed_window", _REPORT_SQL + s.within("r.contact_date"))
def _(t, p):
    return t.contact_report.where(is_.in_window("contact_date", p.window)).select(*_REPORT)


@check("flt_rolling_window", _REPORT_SQL + f"r.contact_date >= {s.ROLLING} AND r.contact_date <= {s.NOW}")
def _(t, p):
    return t.contact_report.where(is_.in_rolling("contact_date", p)).select(*_REPORT)


@check(
    "flt_rolling_window_minus_day",
    _REPORT_SQL + f"r.contact_date >= {s.ROLLING_EARLY} AND r.contact_date <= {s.NOW}",
)
def _(t, p):
    return t.contact_report.where(is_.in_rolling("contact_date", p, days_earlier=1)).select(*_REPORT)


@check(
    "flt_data_window",
    "SELECT proposal_id, start_date, expected_date, stop_date FROM proposal "
    "WHERE expected_date >= start_date AND expected_date BETWEEN start_date AND stop_date",
)
def _(t, p):
    return t.proposal.where(F.col("expected_date").between(F.col("start_date"), F.col("stop_date"))).select(
        "proposal_id", "start_date", "expected_date", "stop_date"
    )


@check("flt_like_prefix", "SELECT proposal_id, proposal_type FROM proposal WHERE proposal_type LIKE 'MG%'")
def _(t, p):
    return t.proposal.where(is_.is_major_gift()).select("proposal_id", "proposal_type")


@check(
    "flt_id_lists",
    f"""SELECT id_number, unit_code, id_number IN ({s.quoted(P.special_officers)}) AS special,
    id_number IN ({s.quoted(P.leadership)}) AS leadership FROM staff
    WHERE id_number NOT IN ({s.quoted(P.exclude_staff)}) AND unit_code NOT IN ({s.quoted(P.exclude_units)})""",
)
def _(t, p):
    kept = ~F.col("id_number").isin(*p.exclude_staff) & ~F.col("unit_code").isin(*p.exclude_units)
    return t.staff.where(kept).select(
        "id_number",
        "unit_code",
        F.col("id_number").isin(*p.special_officers).alias("special"),
        F.col("id_number").isin(*p.leadership).alias("leadership"),
    )


@check(
    "flt_giving_ind",
    """SELECT id_number, prog_hier_num = '1' AS annual_fund, count(*) AS gifts,
    CAST(sum(prim_amt) AS DECIMAL(28,2)) AS amount FROM ucdr_giving
    WHERE giving_ind IN ('P', 'G') GROUP BY ALL""",
)
def _(t, p):
    return (
        t.ucdr_giving.where(is_.is_gift_or_pledge())
        .groupBy("id_number", is_.is_annual_fund().alias("annual_fund"))
        .agg(F.count("*").alias("gifts"), F.sum("prim_amt").cast("decimal(28,2)").alias("amount"))
    )


@check(
    "flt_open_or_recent",
    f"SELECT proposal_id, stop_date FROM proposal WHERE NOT coalesce(stop_date < {s.stamp(P.stop_from)}, FALSE)",
)
def _(t, p):
    return t.proposal.where(is_.open_or_stopped_since("stop_date", p.stop_from)).select("proposal_id", "stop_date")


@check(
    "flt_null_tests",
    """SELECT assignment_type, count(*) - count(start_date) AS no_start, count(stop_date) AS stopped,
    count(*) - count(proposal_id) AS no_proposal FROM assignment GROUP BY ALL""",
)
def _(t, p):
    return t.assignment.groupBy("assignment_type").agg(
        F.count_if(F.col("start_date").isNull()).alias("no_start"),
        F.count_if(F.col("stop_date").isNotNull()).alias("stopped"),
        F.count_if(F.col("proposal_id").isNull()).alias("no_proposal"),
    )


@check(
    "flt_primary",
    """SELECT prospect_id, id_number, primary_ind FROM prospect_entity WHERE primary_ind = 'Y'
    UNION ALL SELECT prosp_id, id_number, prim_prosp_ind FROM ucdr_prospect_pool WHERE prim_prosp_ind = 'Y'""",
)
def _(t, p):
    bridge = t.prospect_entity.where(is_.is_primary("primary_ind"))
    pool = t.ucdr_prospect_pool.where(is_.is_primary("prim_prosp_ind"))
    return bridge.union(pool.select("prosp_id", "id_number", "prim_prosp_ind"))


@check("flt_dev_staff", "SELECT id_number, sort, staff_type_code FROM staff WHERE staff_type_code = 'DEV'")
def _(t, p):
    return t.staff.where(is_.is_development_staff()).select("id_number", "sort", "staff_type_code")


@check(
    "flt_assignment_type",
    """SELECT assignment_type, count(*) AS n, count(*) FILTER (assignment_type IN ('S', 'LM')) AS held,
    count(*) FILTER (assignment_type = 'SL') AS solicited FROM assignment WHERE active_ind = 'Y' GROUP BY ALL""",
)
def _(t, p):
    return (
        t.assignment.where(is_.is_assignment("LM", "S", "SL"))
        .groupBy("assignment_type")
        .agg(
            F.count("*").alias("n"),
            F.count_if(is_.is_assignment("S", "LM")).alias("held"),
            F.count_if(is_.is_assignment("SL")).alias("solicited"),
        )
    )


@check(
    "flt_priority",
    """SELECT assignment_id_number, count(*) FILTER (priority_code = 'PQ') AS pq,
    count(*) FILTER (priority_code = 'PM') AS pm FROM assignment GROUP BY ALL""",
)
def _(t, p):
    return t.assignment.groupBy("assignment_id_number").agg(
        F.count_if(is_.has_priority("PQ")).alias("pq"), F.count_if(is_.has_priority("PM")).alias("pm")
    )


@check(
    "flt_stage_code",
    """SELECT proposal_id, prospect_id, stage_code, stage_code IN ('AM', 'DN', 'GC', 'PL', 'ST') AS ask_made,
    stage_code IN ('GC', 'PL', 'ST') AS closed, stage_code IN ('AM', 'GC', 'DN', 'ST') AS asked_in_history
    FROM proposal""",
)
def _(t, p):
    stage = F.col("stage_code")
    return t.proposal.select(
        "proposal_id",
        "prospect_id",
        "stage_code",
        stage.isin(*is_.ASK_MADE_STAGES).alias("ask_made"),
        stage.isin(*is_.CLOSED_STAGES).alias("closed"),
        stage.isin(*is_.ASK_IN_HISTORY).alias("asked_in_history"),
    )
