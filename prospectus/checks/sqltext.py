"""Building blocks of the check SQL (DuckDB dialect), with the test parameters filled in.

The SQL joins events to cohort rows one by one and uses correlated subqueries, where the Spark side aggregates first. It
is slow and literal on purpose: the two share no shortcut that could hide an error in both.
"""

from __future__ import annotations

from datetime import datetime

from prospectus.params import Window
from prospectus.sources.staged import STAGED_PARAMS as P


def stamp(at: datetime) -> str:
    return f"TIMESTAMP '{at.isoformat(sep=' ')}'"


NOW = stamp(P.as_of)
ROLLING = f"({NOW} - INTERVAL 13 MONTH)"
ROLLING_EARLY = f"({NOW} - INTERVAL 13 MONTH - INTERVAL 1 DAY)"


def within(column: str, window: Window = P.window) -> str:
    return f"{column} BETWEEN {stamp(window[0])} AND {stamp(window[1])}"


def visit(a: str) -> str:
    return f"({a}.contact_type = 'V' OR {a}.contact_type IN ('C', 'P') AND {a}.contact_initiated_by = 'FCGS')"


def contact(a: str) -> str:
    return f"{a}.contact_type IN ('C', 'V', 'P', '1')"


def purpose(a: str, *codes: str) -> str:
    listed = ", ".join(f"'{c}'" for c in codes)
    return f"({a}.contact_purpose_code IN ({listed}) AND {a}.contact_type IN ('V', 'C', 'P'))"


def days(start: str, end: str) -> str:
    return f"(CAST(date_diff('microsecond', {start}, {end}) AS DOUBLE) / 86400000000)"


def years(start: str, end: str) -> str:
    return f"({days(start, end)} / 365)"


def years2(start: str, end: str) -> str:
    """Years to two places."""
    return f"(floor({days(start, end)} * 100 / 365.0 + 0.5) / 100)"


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def cohort(
    atype: str = "LM", named: bool = True, active_staff: bool = True, start: str | None = None, om: bool = False
) -> str:
    columns = ["pr.prospect_id", "st.id_number AS officer_id", "pr.stage_code", "asg.priority_code"]
    if named:
        columns += ["st.sort AS officer_name", "ts.short_desc AS stage_desc", "asg.assignment_type"]
    if start:
        started = "asg.start_date" if start == "assigned" else "coalesce(asg.start_date, asg.date_added)"
        columns.append(f"{started} AS start_date")
    tests = ["pr.active_ind = 'Y'", "asg.active_ind = 'Y'", f"asg.assignment_type = '{atype}'"]
    tests.append("st.staff_type_code = 'DEV'")
    if active_staff:
        tests.append("st.active_ind = 'Y'")
    if om:
        tests.append(f"st.id_number NOT IN ({quoted(P.exclude_staff)})")
        tests.append(f"st.unit_code NOT IN ({quoted(P.exclude_units)})")
    return (
        f"SELECT DISTINCT {', '.join(columns)} FROM assignment asg "
        "JOIN prospect pr ON pr.prospect_id = asg.prospect_id "
        "JOIN staff st ON st.id_number = asg.assignment_id_number "
        "LEFT JOIN tms_stage ts ON ts.stage_code = pr.stage_code "
        f"WHERE {' AND '.join(tests)}"
    )


MANAGED = cohort(named=False, active_staff=False, start="assigned")
MANAGED_FALLBACK = cohort(named=False, active_staff=False, start="fallback")
OM = cohort(start="assigned", om=True)

OFFICER_TYPE = (
    "CASE un.short_desc WHEN 'Planned Giving' THEN 'Planned Giving Officer' "
    "WHEN 'Principal Gifts' THEN 'Principal Gifts Officer' "
    "WHEN 'Foundation & Corporate Giving' THEN 'Foundation and Corporate Officer' "
    "WHEN 'Annual & Special Gifts' THEN 'Annual Special' ELSE "
    f"CASE WHEN {{officer}} IN ({quoted(P.special_officers)}) THEN 'Annual Special' "
    f"WHEN {{officer}} IN ({quoted(P.leadership)}) THEN 'Leadership' ELSE 'Major Gift Officer' END END"
)


def quartile(ratio: str) -> str:
    return (
        f"CASE WHEN {ratio} >= 0.75 OR ({ratio}) IS NULL THEN '75%+' WHEN {ratio} >= 0.5 THEN '50%-75%' "
        f"WHEN {ratio} >= 0.25 THEN '25%-50%' ELSE '<25%' END"
    )


def recommended(kind: str, size: str) -> str:
    tests = " ".join(f"WHEN {kind} = '{k}' THEN CASE WHEN {size} >= {n} THEN 'Yes' ELSE 'No' END"
                     for k, n in P.size_minimum.items())
    return f"CASE {tests} WHEN {kind} = 'Leadership' THEN 'N/A' ELSE 'No' END"


def fiscal_year(column: str) -> str:
    tests = " ".join(f"WHEN {within(column, w)} THEN '{label}'" for w, label in P.fiscal_years)
    return f"CASE WHEN {column} IS NULL THEN '{P.open_fiscal_year}' {tests} END"


def ask_gap(start: str, last_ask: str) -> str:
    return (
        f"CASE WHEN {days(start, NOW)} < 216 THEN 'RM < 18 Mo' "
        f"WHEN {days(last_ask, NOW)} >= 216 THEN 'Y' ELSE 'N' END"
    )


RANGE_LABEL = (
    f"(upper(strftime({ROLLING_EARLY}, '%d-%b-%y')) || ' - ' || upper(strftime({NOW}, '%d-%b-%y')))"
)


def window_text(window: Window) -> str:
    return "'" + " - ".join(f"{d.month}/{d.day}/{d.year}" for d in window) + "'"


# Per proposal and stage: days until the next strictly later stage date of the proposal, or until now.
STAGE_SPANS = f"""
SELECT s1.proposal_id, s1.stage_code, s1.stage_date,
       (SELECT min(s2.stage_date) FROM stage s2
        WHERE s2.proposal_id = s1.proposal_id AND s2.stage_date > s1.stage_date) AS next_date
FROM stage s1 WHERE s1.proposal_id IS NOT NULL
"""


def stage_days(code: str) -> str:
    micros = f"date_diff('microsecond', stage_date, coalesce(next_date, {NOW}))"
    return f"CAST(sum({micros}) FILTER (stage_code = '{code}') AS DOUBLE) / 86400000000"


STAGE_CODES = ("RB", "AM", "GC", "ST", "PL", "DN", "DP")
STAGE_DAYS = (
    "SELECT proposal_id, " + ", ".join(f"{stage_days(c)} AS days_{c.lower()}" for c in STAGE_CODES)
    + f" FROM ({STAGE_SPANS}) GROUP BY proposal_id"
)

TIME_AT_STAGE = """
SELECT prospect_id, stage_date, stage_code, officer_id FROM (
  SELECT c.prospect_id, sg.stage_date, c.stage_code, c.officer_id, row_number() OVER (
           PARTITION BY c.prospect_id
           ORDER BY sg.date_added DESC NULLS FIRST, sg.stage_date DESC NULLS FIRST, c.officer_id) AS place
  FROM cohort c LEFT JOIN stage sg ON sg.prospect_id = c.prospect_id AND sg.stage_code = c.stage_code)
WHERE place = 1
"""

TIME_AT_PROPOSAL_STAGE = """
SELECT prospect_id, proposal_id, stage_code, stage_date, officer_id FROM (
  SELECT c.prospect_id, pl.proposal_id, pl.stage_code, sg.stage_date, c.officer_id, row_number() OVER (
           PARTITION BY c.prospect_id, pl.proposal_id
           ORDER BY sg.date_added DESC NULLS FIRST, sg.stage_date DESC NULLS FIRST, c.officer_id) AS place
  FROM cohort c JOIN proposal pl ON pl.prospect_id = c.prospect_id AND starts_with(pl.proposal_type, 'MG')
  LEFT JOIN stage sg ON sg.prospect_id = c.prospect_id AND sg.stage_code = pl.stage_code
                    AND sg.proposal_id = pl.proposal_id)
WHERE place = 1
"""


def own_activity(tests: dict[str, str], extra: str = "TRUE") -> str:
    """Counts per (prospect, author) of the cohort's own officers in the window."""
    counted = ", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in tests.items())
    return (
        f"SELECT c.prospect_id, r.author_id_number AS author_id, {counted} FROM cohort c "
        "LEFT JOIN contact_report r ON r.prospect_id = c.prospect_id AND r.author_id_number = c.officer_id "
        f"AND {within('r.contact_date')} WHERE {extra} GROUP BY ALL"
    )


def any_activity(tests: dict[str, str]) -> str:
    counted = ", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in tests.items())
    return (
        f"SELECT c.prospect_id, {counted} FROM cohort c LEFT JOIN contact_report r "
        f"ON r.prospect_id = c.prospect_id AND {within('r.contact_date')} GROUP BY ALL"
    )


ANY_TESTS = {
    "contacts": contact("r"),
    "visits": visit("r"),
    "ask_or_special": purpose("r", "A", "B"),
    "ask": purpose("r", "A"),
    "special": purpose("r", "B"),
}
OWN_TESTS = {
    **ANY_TESTS,
    "strategy": "r.contact_type = 'S'",
    "dq_nn_nr": "r.contact_outcome IN ('DD', 'NN', 'NR')",
    "qu": "r.contact_outcome = 'QU'",
    "qualified": "r.contact_outcome <> ' '",
}

GIVING = f"""
SELECT c.prospect_id, CAST(sum(g.prim_amt) AS DECIMAL(28,2)) AS total_giving
FROM cohort c JOIN ucdr_prospect_pool pool ON pool.prosp_id = c.prospect_id AND pool.prim_prosp_ind = 'Y'
JOIN ucdr_giving g ON g.id_number = pool.id_number WHERE {within('g.date_of_record')} GROUP BY ALL
"""

DROPPED = f"""
SELECT pl.proposal_id, pl.prospect_id FROM proposal pl
WHERE starts_with(pl.proposal_type, 'MG') AND {within('pl.start_date')}
  AND EXISTS (SELECT 1 FROM stage h WHERE h.proposal_id = pl.proposal_id AND h.stage_code = 'DP')
  AND {within('pl.date_added')}
  AND NOT EXISTS (SELECT 1 FROM stage h WHERE h.proposal_id = pl.proposal_id
                  AND h.stage_code IN ('AM', 'GC', 'DN', 'ST'))
"""

PROPOSALS = f"""
SELECT c.prospect_id, count(*) AS proposals,
       count(*) FILTER (pl.stage_code IN ('AM', 'DN', 'GC', 'PL', 'ST')) AS ask_made,
       (SELECT count(*) FROM ({DROPPED}) d WHERE d.prospect_id = c.prospect_id) AS dropped_before_ask,
       count(*) FILTER (pl.stage_code IN ('GC', 'PL', 'ST')) AS closed
FROM cohort c JOIN proposal pl ON pl.prospect_id = c.prospect_id
WHERE starts_with(pl.proposal_type, 'MG') AND {within('pl.start_date')} GROUP BY c.prospect_id
"""

ALL_ASSIGNMENTS = """
SELECT DISTINCT asg.assignment_id_number AS officer_id, asg.prospect_id, pe.id_number AS entity_id
FROM assignment asg LEFT JOIN prospect_entity pe ON pe.prospect_id = asg.prospect_id
WHERE asg.active_ind = 'Y' AND asg.proposal_id IS NULL AND asg.assignment_type IN ('S', 'LM')
  AND asg.assignment_id_number IN (SELECT officer_id FROM cohort)
"""


def entity_visits(anti: bool) -> str:
    outside = (
        f"AND NOT EXISTS (SELECT 1 FROM ({ALL_ASSIGNMENTS}) aa "
        "WHERE aa.officer_id = r.author_id_number AND aa.entity_id = r.id_number)"
        if anti else ""
    )
    return (
        "SELECT r.author_id_number AS officer_id, r.id_number AS entity_id, count(r.report_id) AS visits "
        f"FROM contact_report r WHERE {visit('r')} AND {within('r.contact_date')} "
        f"AND r.author_id_number IN (SELECT officer_id FROM cohort) {outside} GROUP BY ALL"
    )


def role_size(atype: str) -> str:
    return (
        "SELECT asg.assignment_id_number AS officer_id, count(DISTINCT asg.prospect_id) AS role_size "
        "FROM assignment asg JOIN prospect pr ON pr.prospect_id = asg.prospect_id "
        "JOIN staff st ON st.id_number = asg.assignment_id_number "
        f"WHERE asg.assignment_type = '{atype}' AND asg.active_ind = 'Y' AND pr.active_ind = 'Y' "
        "AND st.active_ind = 'Y' AND st.staff_type_code = 'DEV' GROUP BY ALL"
    )


def officer_portfolio(columns: str = "*") -> str:
    counted = ", ".join(
        f"count(*) FILTER (c.stage_code = '{code}') AS {name}"
        for code, name in (("Q", "n_q"), ("CU", "n_cu"), ("SO", "n_so"), ("ST", "n_st"), ("PL", "n_pl"), ("PS", "n_ps"))
    )
    inner = (
        "SELECT c.officer_id, c.officer_name, count(*) AS portfolio_size, "
        "count(*) FILTER (c.priority_code = 'PQ') AS pq_size, count(*) FILTER (c.priority_code = 'PM') AS pm_size, "
        f"{counted}, any_value(ofc.short_desc) AS office, any_value(un.short_desc) AS unit, "
        f"any_value({years('coalesce(st.start_date, st.date_added)', NOW)}) AS years_as_officer, "
        f"any_value({OFFICER_TYPE.format(officer='c.officer_id')}) AS officer_type "
        "FROM cohort c LEFT JOIN staff st ON st.id_number = c.officer_id "
        "LEFT JOIN tms_office ofc ON ofc.office_code = st.office_code "
        "LEFT JOIN tms_unit_code un ON un.unit_code = st.unit_code GROUP BY c.officer_id, c.officer_name"
    )
    return f"SELECT {columns} FROM ({inner})"


def with_cohort(sql: str, cohort_sql: str | None = None) -> str:
    return f"WITH cohort AS ({cohort_sql or cohort()})\n{sql}"
