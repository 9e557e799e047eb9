"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectus.checks import sqltext as s
from prospectus.checks.published import COUNT_COLUMNS
from prospectus.checks.registry import check
from prospectus.operators import contacts, giving, proposals, stages
from prospectus.operators.cohorts import cohort_pairs, om_cohort, prospect_cohort
from prospectus.plans import flows
from prospectus.plans.officer_management import removed_by_rm
from prospectus.plans.percents import coverage_percents
from prospectus.plans.scorecard import scorecards
from prospectus.sources.staged import STAGED_PARAMS as P


def _managed(t):
    return prospect_cohort(t, named=False, require_active_staff=False, start="assigned")


def _held(t, p):
    return contacts.by_cohort_officer(cohort_pairs(_managed(t)), contacts.coverage_tallies(t, p))


def _coverage(by_author: bool, rolling: str | None = None, latest: bool = True) -> str:
    keys = "c.prospect_id, r.author_id_number AS author_id" if by_author else "c.prospect_id"
    join = "r.prospect_id = c.prospect_id AND " + s.contact("r")
    if by_author:
        join += " AND r.author_id_number = c.officer_id"
    if rolling:
        join += f" AND r.contact_date BETWEEN {rolling} AND {s.NOW}"
    last = f", max(r.contact_date) FILTER ({s.visit('r')}) AS latest_visit" if latest else ""
    return (
        f"SELECT {keys}, count(r.contact_type) AS contacts, count(*) FILTER ({s.visit('r')}) AS visits{last} "
        f"FROM cohort c LEFT JOIN contact_report r ON {join} GROUP BY ALL"
    )


RECENT_BY_AUTHOR = _coverage(True, s.ROLLING, latest=False)
RECENT_BY_PROSPECT = _coverage(False, s.ROLLING, latest=False)
ALL_BY_AUTHOR = _coverage(True)
ALL_BY_PROSPECT = _coverage(False)


@check("agg_contacts_rm_all", s.with_cohort(ALL_BY_AUTHOR, s.MANAGED))
def _(t, p):
    return contacts.contacts_by_officer(_held(t, p))


@check("agg_contacts_any_all", s.with_cohort(ALL_BY_PROSPECT, s.MANAGED))
def _(t, p):
    found = contacts.contacts_by_prospect(_managed(t), contacts.coverage_tallies(t, p))
    return found.select("prospect_id", "contacts", "visits", "latest_visit")


@check("agg_contacts_rm_rolling", s.with_cohort(RECENT_BY_AUTHOR, s.MANAGED))
def _(t, p):
    return contacts.recent_contacts_by_officer(_held(t, p)).toDF("prospect_id", "author_id", "contacts", "visits")


@check("agg_contacts_any_rolling", s.with_cohort(RECENT_BY_PROSPECT, s.MANAGED))
def _(t, p):
    found = contacts.contacts_by_prospect(_managed(t), contacts.coverage_tallies(t, p))
    return found.select("prospect_id", F.col("recent_contacts").alias("contacts"), F.col("recent_visits").alias("visits"))


@check("agg_contacts_officer_window", s.with_cohort(s.own_activity(s.OWN_TESTS)))
def _(t, p):
    return contacts.officer_activity(prospect_cohort(t), t, p)


@check("agg_contacts_any_window", s.with_cohort(s.any_activity(s.ANY_TESTS)))
def _(t, p):
    return contacts.any_officer_activity(prospect_cohort(t), t, p)


_PRIORITY_COLUMNS = ("visits", "ask", "strategy", "qualified")
_PRIORITY_TESTS = {name: s.OWN_TESTS[name] for name in _PRIORITY_COLUMNS}


@check("agg_contacts_pq", s.with_cohort(s.own_activity(_PRIORITY_TESTS, "c.priority_code = 'PQ'")))
def _(t, p):
    activity = contacts.officer_activity(prospect_cohort(t), t, p, "PQ")
    return activity.select("prospect_id", "author_id", *_PRIORITY_COLUMNS)


@check("agg_contacts_pm", s.with_cohort(s.own_activity(_PRIORITY_TESTS, "c.priority_code = 'PM'")))
def _(t, p):
    activity = contacts.officer_activity(prospect_cohort(t), t, p, "PM")
    return activity.select("prospect_id", "author_id", *_PRIORITY_COLUMNS)


@check("agg_giving_window", s.with_cohort(s.GIVING))
def _(t, p):
    return giving.giving_in_window(prospect_cohort(t), t, p)


@check("agg_proposals", s.with_cohort(s.PROPOSALS))
def _(t, p):
    return proposals.proposal_counts(prospect_cohort(t), t, p)


@check("agg_dropped_before_ask", f"SELECT prospect_id, count(*) AS dropped FROM ({s.DROPPED}) GROUP BY ALL")
def _(t, p):
    dropped = proposals.windowed_proposals(t, p).where("dropped")
    return dropped.groupBy("prospect_id").agg(F.count("*").alias("dropped"))


FIRST_ASK = """
SELECT c.prospect_id, c.officer_id, c.start_date, min(r.contact_date) AS ask_date
FROM cohort c LEFT JOIN contact_report r ON r.prospect_id = c.prospect_id AND r.author_id_number = c.officer_id
  AND r.contact_purpose_code = 'A' AND r.contact_date >= c.start_date GROUP BY ALL
"""

VISITS_TO_ASK = f"""
SELECT f.prospect_id, count(r.report_id) AS visits FROM ({FIRST_ASK}) f LEFT JOIN contact_report r
  ON r.prospect_id = f.prospect_id AND r.author_id_number = f.officer_id AND r.contact_purpose_code = 'A'
  AND r.contact_type = 'V' AND r.contact_date >= f.start_date AND r.contact_date <= f.ask_date GROUP BY ALL
"""


@check("agg_first_ask", s.with_cohort(FIRST_ASK, s.OM))
def _(t, p):
    return contacts.first_ask(om_cohort(t, p), t).drop("visits")


@check("agg_visits_to_ask", s.with_cohort(VISITS_TO_ASK, s.OM))
def _(t, p):
    return contacts.visits_to_ask(contacts.first_ask(om_cohort(t, p), t))


REMOVED = f"""
SELECT c.officer_name, count(asg.stop_date) AS total_removed FROM cohort c
LEFT JOIN assignment asg ON asg.prospect_id = c.prospect_id AND asg.assignment_type = 'LM' AND asg.active_ind = 'N'
  AND {s.within('asg.stop_date', P.om_window)} GROUP BY ALL
"""


@check("agg_removed", s.with_cohort(REMOVED, s.OM))
def _(t, p):
    return removed_by_rm(om_cohort(t, p), t, p)


@check(
    "agg_stage_days",
    f"""SELECT proposal_id, stage_code,
    CAST(sum(date_diff('microsecond', stage_date, coalesce(next_date, {s.NOW}))) AS DOUBLE) / 86400000000 AS days
    FROM ({s.STAGE_SPANS}) GROUP BY ALL""",
)
def _(t, p):
    return stages.days_per_stage(t, p)


@check(
    "agg_outside_visits",
    s.with_cohort(f"SELECT officer_id, count(*) AS entities FROM ({s.entity_visits(True)}) GROUP BY ALL"),
)
def _(t, p):
    return contacts.outside_entities(prospect_cohort(t), t, p)


def year_counts(column: str, total: str) -> str:
    return (
        f"SELECT count(*) AS {total}, count(*) FILTER ({s.within(column, P.year1)}) AS year1, "
        f"count(*) FILTER ({s.within(column, P.year2)}) AS year2 FROM (SELECT DISTINCT pr.prospect_id, pr.{column} "
        "FROM prospect pr LEFT JOIN assignment asg ON asg.prospect_id = pr.prospect_id "
        f"AND asg.assignment_type = '{{role}}' WHERE {s.within('pr.' + column)})"
    )


ADDED = year_counts("start_date", "prospects_added")
STOPPED = year_counts("stop_date", "prospects_dropped")


@check(
    "agg_year_counts",
    f"""SELECT 'LM' AS role, a.prospects_added AS added, d.prospects_dropped AS dropped,
    a.year1 AS added1, a.year2 AS added2, d.year1 AS dropped1, d.year2 AS dropped2
    FROM ({ADDED.format(role='LM')}) a, ({STOPPED.format(role='LM')}) d
    UNION ALL SELECT 'S', a.prospects_added, d.prospects_dropped, a.year1, a.year2, d.year1, d.year2
    FROM ({ADDED.format(role='S')}) a, ({STOPPED.format(role='S')}) d""",
)
def _(t, p):
    added = flows.prospects_added(t, p).toDF("added", "added1", "added2")
    dropped = flows.prospects_dropped(t, p).toDF("dropped", "dropped1", "dropped2")
    roles = F.explode(F.array(F.lit("LM"), F.lit("S"))).alias("role")
    both = added.withColumn("_one", F.lit(1)).join(dropped.withColumn("_one", F.lit(1)), "_one")
    return both.select(roles, "added", "dropped", "added1", "added2", "dropped1", "dropped2")


@check(
    "agg_dropped_nn_dq",
    f"""SELECT count(DISTINCT pr.prospect_id) AS dropped_nn_dq FROM prospect pr
    JOIN contact_report r ON r.prospect_id = pr.prospect_id
    WHERE r.contact_outcome IN ('NN', 'DQ') AND {s.within('pr.stop_date')}""",
)
def _(t, p):
    return flows.dropped_nn_dq(t, p)


VISITS_BY_AUTHOR = f"""
SELECT r.author_id_number AS author_id, bio.sort_name AS author_name,
  count(*) FILTER (st.id_number = r.author_id_number) AS visits_by_rm,
  count(*) FILTER (st.id_number <> r.author_id_number) AS visits_by_non_rm,
  count(*) FILTER (st.id_number IS NULL) AS no_rm, count(*) FILTER (asg.priority_code = 'PQ') AS visits_pq
FROM contact_report r LEFT JOIN ucdr_bio bio ON bio.id_number = r.author_id_number
LEFT JOIN prospect pr ON pr.prospect_id = r.prospect_id
LEFT JOIN assignment asg ON asg.prospect_id = pr.prospect_id AND asg.assignment_type = 'LM' AND asg.active_ind = 'Y'
LEFT JOIN staff st ON st.id_number = asg.assignment_id_number
WHERE {s.visit('r')} AND {s.within('r.contact_date', P.om_window)} GROUP BY ALL
"""


@check("agg_visits_by_author", VISITS_BY_AUTHOR)
def _(t, p):
    return contacts.visits_by_author(t, p)


_MEASURES = ("contacted_by_rm", "contacted_by_anyone", "visited_by_rm", "visited_by_anyone")


def coverage_sql(extra: str = "") -> str:
    """Coverage with every join spelled out row by row."""
    tests = {
        "contacted_by_rm": "rr.contacts <> 0",
        "contacted_by_anyone": "ra.contacts <> 0",
        "visited_by_rm": "rr.visits <> 0",
        "visited_by_anyone": "ra.visits <> 0",
    }
    counted = ", ".join(
        f"count(*) FILTER ({test}) AS {m}, count(*) FILTER ({test}) / ol.portfolio_size AS pct_{m}"
        for m, test in tests.items()
    )
    return s.with_cohort(
        f"""SELECT st.sort AS rm_name, ol.portfolio_size, {counted}{extra}
        FROM cohort c LEFT JOIN staff st ON st.id_number = c.officer_id
        LEFT JOIN ({ALL_BY_AUTHOR}) ar ON ar.prospect_id = c.prospect_id
        LEFT JOIN ({RECENT_BY_AUTHOR}) rr ON rr.prospect_id = c.prospect_id
        LEFT JOIN ({ALL_BY_PROSPECT}) aa ON aa.prospect_id = c.prospect_id
        LEFT JOIN ({RECENT_BY_PROSPECT}) ra ON ra.prospect_id = c.prospect_id
        LEFT JOIN (SELECT asg.assignment_id_number AS officer_id, count(*) AS portfolio_size FROM assignment asg
                   JOIN prospect pr ON pr.prospect_id = asg.prospect_id
                   WHERE asg.assignment_type = 'LM' AND asg.active_ind = 'Y' AND pr.active_ind = 'Y' GROUP BY ALL) ol
          ON ol.officer_id = c.officer_id
        GROUP BY st.sort, ol.portfolio_size""",
        s.MANAGED,
    )


@check("agg_coverage_percents", coverage_sql())
def _(t, p):
    return coverage_percents(t, p)


@check(
    "agg_distinct",
    "SELECT assignment_id_number, assignment_type, priority_code FROM assignment GROUP BY ALL",
)
def _(t, p):
    return t.assignment.select("assignment_id_number", "assignment_type", "priority_code").distinct()


def scorecard_counts(t, p):
    return scorecards(t, p, *COUNT_COLUMNS)
