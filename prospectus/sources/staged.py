"""The 15 source tables derived from the generic test tables, as described in FIXTURES.md.

One mapping of column -> expression serves both engines: Spark selects the expressions from joined DataFrames, and the
check SQL gets them as a WITH prelude. Expressions are limited to syntax both accept.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectus.params import ReportParams
from prospectus.sources.schemas import TABLE_NAMES
from prospectus.sources.tables import Tables

STAGED_PARAMS = ReportParams(
    as_of=datetime(2001, 8, 2),
    window=(datetime(1998, 7, 1), datetime(2000, 6, 30)),
    om_window=(datetime(1998, 7, 1), datetime(2000, 5, 15)),
    year1=(datetime(1998, 7, 1), datetime(1999, 6, 30)),
    year2=(datetime(1999, 7, 1), datetime(2000, 6, 30)),
    stop_from=datetime(1998, 7, 1),
    fiscal_years=(
        ((datetime(2000, 7, 1), datetime(2001, 6, 30)), "FY 16-17"),
        ((datetime(1999, 7, 1), datetime(2000, 6, 30)), "FY 16-17"),
        ((datetime(1998, 7, 1), datetime(1999, 6, 30)), "FY 15-16"),
    ),
    exclude_staff=("9000000006",),
    special_officers=("9000000004",),
    leadership=("9000000005",),
    size_minimum={
        "Planned Giving Officer": 12,
        "Principal Gifts Officer": 10,
        "Foundation and Corporate Officer": 10,
        "Annual Special": 14,
    },
)


def _day_offset(key: str, factor: int, span: int, base: int = 0) -> str:
    """A date within ``span`` days of 1995-01-01, spread over the keys."""
    days = f"{key} * {factor} % {span}" if not base else f"{base} + {key} * {factor} % {span}"
    return f"TIMESTAMP '1995-01-01 00:00:00' + CAST({days} AS INT) * INTERVAL '1' DAY"


def _case(subject: str, values: list[str], default: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {subject} {whens} ELSE '{default}' END"


def _padded(key: str, width: int) -> str:
    return f"lpad(CAST({key} AS STRING), {width}, '0')"


def _officer(key: str) -> str:
    return f"concat('9', {_padded(key, 9)})"


def _money(amount: str) -> str:
    return f"CAST({amount} AS DECIMAL(18,2))"


_STAGE_OF_PROSPECT = _case("c_custkey % 7", ["Q", "CU", "SO", "ST", "PL", "PS"], "Q")
_UNITS = ["PG", "PRG", "FCG", "ASGP"]
_SPOUSE = "CASE WHEN c_custkey % 3 = 0 THEN {} END"

_LINES = (("lineitem", None), ("orders", "l_orderkey = o_orderkey"))

# Tables whose queries go on in the tasks of the join that makes them, with sorts and hash tables of their own.
_LONG_TASKS = ("stage",)
#: Rows of the first table of such a join that one task takes, on average.
ROWS_PER_TASK = 500_000

# table -> list of (sources with join conditions, filter, columns); several entries are united with UNION ALL.
_MAPPING: dict[str, list[tuple[tuple, str | None, dict[str, str]]]] = {
    "prospect": [((("customer", None),), None, {
        "prospect_id": "c_custkey",
        "active_ind": "CASE WHEN c_custkey % 10 = 9 THEN 'N' ELSE 'Y' END",
        "stage_code": _STAGE_OF_PROSPECT,
        "start_date": _day_offset("c_custkey", 131, 2400),
        "stop_date": f"CASE WHEN c_custkey % 4 = 0 THEN {_day_offset('c_custkey', 97, 1600, 700)} END",
    })],
    "assignment": [(_LINES, "l_linenumber <= 2", {
        "prospect_id": "o_custkey",
        "assignment_id_number": _officer("l_suppkey"),
        "assignment_type": "CASE l_returnflag WHEN 'A' THEN 'LM' WHEN 'N' THEN 'S' ELSE 'SL' END",
        "active_ind": "CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'Y' ELSE 'N' END",
        "priority_code": "CASE WHEN l_orderkey % 2 = 0 THEN 'PQ' ELSE 'PM' END",
        "start_date": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END",
        "date_added": "o_orderdate",
        "stop_date": "CASE WHEN l_linestatus = 'F' THEN l_shipdate END",
        "proposal_id": "CASE WHEN l_returnflag NOT IN ('A', 'N') THEN l_orderkey END",
    })],
    "staff": [((("supplier", None), ("nation", "s_nationkey = n_nationkey")), None, {
        "id_number": _officer("s_suppkey"),
        "sort": "s_name",
        "staff_type_code": "CASE WHEN s_suppkey % 10 < 8 THEN 'DEV' ELSE 'ADM' END",
        "active_ind": "CASE WHEN s_suppkey % 9 = 8 THEN 'N' ELSE 'Y' END",
        "unit_code": _case("s_suppkey % 6", _UNITS, "MG"),
        "office_code": "CAST(n_regionkey AS STRING)",
        "start_date": f"CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE {_day_offset('s_suppkey', 37, 2000)} END",
        "date_added": _day_offset("s_suppkey", 37, 2000),
    })],
    "contact_report": [(_LINES, None, {
        "report_id": "l_orderkey * 10 + l_linenumber",
        "prospect_id": "o_custkey",
        "id_number": _padded("CASE WHEN l_partkey % 50 = 0 THEN o_custkey + 1 ELSE o_custkey END", 10),
        "author_id_number": _officer("l_suppkey"),
        "contact_type": _case("l_linenumber - 1", ["V", "C", "P", "S", "V", "1"], "X"),
        "contact_initiated_by": "CASE WHEN l_partkey % 3 = 0 THEN 'FCGS' ELSE 'DO' END",
        "contact_purpose_code": _case("l_partkey % 4", ["A", "B"], "C"),
        "contact_outcome": "CASE l_partkey % 9 WHEN 0 THEN 'QU' WHEN 1 THEN 'NN' WHEN 2 THEN 'DQ' WHEN 3 THEN 'DD' "
        "WHEN 4 THEN 'NR' WHEN 5 THEN 'DU' WHEN 6 THEN 'QO' WHEN 7 THEN ' ' END",
        "contact_date": "l_shipdate",
    })],
    "proposal": [((("orders", None),), None, {
        "proposal_id": "o_orderkey",
        "prospect_id": "o_custkey",
        "proposal_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'MGL' WHEN '2-HIGH' THEN 'MGS' "
        "WHEN '3-MEDIUM' THEN 'MGP' ELSE 'AF' END",
        "active_ind": "CASE WHEN o_orderstatus = 'F' THEN 'N' ELSE 'Y' END",
        "proposal_status_code": "o_orderstatus",
        "stage_code": _case("o_orderkey % 7", ["RB", "AM", "GC", "ST", "PL", "DN"], "DP"),
        "start_date": "o_orderdate",
        "stop_date": "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + 300 * INTERVAL '1' DAY END",
        "date_added": "o_orderdate",
        "proposal_title": "concat('Proposal ', CAST(o_orderkey AS STRING))",
        "original_ask_amt": _money("o_totalprice"),
        "ask_amt": f"CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN {_money('0')} "
        f"ELSE {_money('o_totalprice')} END",
        "anticipated_amt": _money("o_totalprice"),
        "granted_amt": f"CASE WHEN o_orderstatus = 'F' THEN {_money(_money('o_totalprice') + ' - 1000')} END",
        "initial_contribution_date": "o_orderdate + 60 * INTERVAL '1' DAY",
        "expected_date": "o_orderdate + CAST(o_orderkey % 700 AS INT) * INTERVAL '1' DAY",
        "plan_gift_ind": "CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE 'N' END",
        "unit_code": _case("o_orderkey % 6", _UNITS, "MG"),
    })],
    "stage": [
        (_LINES, None, {
            "prospect_id": "o_custkey",
            "proposal_id": "l_orderkey",
            "stage_code": _case("l_linenumber - 1", ["RB", "AM", "GC", "ST", "PL", "DN"], "DP"),
            "stage_date": "l_shipdate",
            "date_added": "l_shipdate + l_linenumber * INTERVAL '1' DAY",
        }),
        ((("customer", None),), None, {
            "prospect_id": "c_custkey",
            "proposal_id": "CAST(NULL AS BIGINT)",
            "stage_code": _STAGE_OF_PROSPECT,
            "stage_date": _day_offset("c_custkey", 53, 2300),
            "date_added": _day_offset("c_custkey", 53, 2300),
        }),
    ],
    "prospect_entity": [((("customer", None),), None, {
        "prospect_id": "c_custkey",
        "id_number": _padded("c_custkey", 10),
        "primary_ind": "CASE WHEN c_custkey % 19 = 0 THEN 'N' ELSE 'Y' END",
    })],
    "ucdr_prospect_pool": [((("customer", None), ("nation", "c_nationkey = n_nationkey"),
                             ("region", "n_regionkey = r_regionkey"), ("m", "c_custkey = m_custkey")), None, {
        "prosp_id": "c_custkey",
        "id_number": _padded("c_custkey", 10),
        "prim_prosp_ind": "CASE WHEN c_custkey % 23 = 0 THEN 'N' ELSE 'Y' END",
        "pers_org_ind": "CASE WHEN c_custkey % 12 = 0 THEN 'O' ELSE 'P' END",
        "sort_name": "c_name",
        "pref_mail_name": "c_name",
        "age": "CAST(25 + c_custkey % 60 AS INT)",
        "spouse_age": f"CAST({_SPOUSE.format('25 + c_custkey % 55')} AS INT)",
        "record_type_code": "c_mktsegment",
        "spouse_record_type_code": _SPOUSE.format("c_mktsegment"),
        "home_business_state": "n_name",
        "home_business_county": "r_name",
        "high_act_ask_plan": "mx",
        "highest_active_ask": "mx",
        "abs_high_capacity_ucdt_asks": _money(
            "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 25000 WHEN c_custkey % 5 = 1 THEN 50000 "
            "WHEN c_custkey % 5 = 2 THEN 99999 WHEN c_custkey % 5 = 3 THEN 100000 ELSE 1500000 END"),
        "abs_high_capacity_ucdt_ask_lvl": "concat('L', CAST(c_custkey % 5 AS STRING))",
        "high_ucdt_or_capacity": _money(
            "CASE WHEN c_custkey % 11 = 0 THEN 0 WHEN c_custkey % 13 = 0 THEN NULL ELSE 75000 END"),
        "lifetime_giving_devel": f"CASE c_custkey % 4 WHEN 0 THEN {_money('0')} WHEN 1 THEN NULL "
        f"ELSE {_money(_money('c_acctbal') + ' * 10')} END",
        "first_fy_gift": "CAST(1995 + c_custkey % 6 AS INT)",
        "first_fy_major_gift": "CAST(1996 + c_custkey % 5 AS INT)",
        "last_fy_gift": "CAST(1999 + c_custkey % 3 AS INT)",
        "last_fy_major_gift": "CAST(2000 + c_custkey % 2 AS INT)",
        "nbr_giving_yrs": "CAST(c_custkey % 7 AS INT)",
        "nbr_of_gifts": "CAST(c_custkey % 40 AS INT)",
        "gift_in_each_of_last_3_fy": "CASE WHEN c_custkey % 6 = 0 THEN 'Y' ELSE 'N' END",
        "last_contact_date": _day_offset("c_custkey", 71, 2300),
        "last_contact_author": _officer("c_custkey % 10"),
        "last_contact_attempt": _day_offset("c_custkey", 61, 2300),
        "last_contact_attempt_auth": _officer("c_custkey % 10"),
        "date_last_face_2_face": _day_offset("c_custkey", 59, 2300),
        "last_face2face_author": _officer("c_custkey % 10"),
        "date_last_mg_ask": f"CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE {_day_offset('c_custkey', 43, 2400)} END",
        "last_mg_ask_author": _officer("c_custkey % 10"),
    })],
    "ucdr_giving": [(_LINES, None, {
        "id_number": _padded("o_custkey", 10),
        "date_of_record": "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_shipdate END",
        "prim_amt": _money("l_extendedprice"),
        "giving_ind": "CASE l_returnflag WHEN 'A' THEN 'G' WHEN 'N' THEN 'P' ELSE 'M' END",
        "prog_hier_num": "CAST(l_linenumber AS STRING)",
    })],
    "ucdr_bio": [((("supplier", None),), None, {"id_number": _officer("s_suppkey"), "sort_name": "s_name"})],
    "tms_office": [((("region", None),), None, {
        "office_code": "CAST(r_regionkey AS STRING)", "short_desc": "r_name"})],
}

# Lookup tables given as rows.
_LOOKUPS: dict[str, tuple[tuple[str, ...], list[tuple[str, ...]]]] = {
    "tms_stage": (("stage_code", "short_desc", "full_desc"), [
        ("Q", "Qual", "Qualification"), ("CU", "Cult", "Cultivation"), ("SO", "Solic", "Active Solicitation"),
        ("ST", "Stew", "Stewardship"), ("PL", "PG Stew", "PG Stewardship"), ("PS", "Perm", "Permanent Stewardship")]),
    "tms_unit_code": (("unit_code", "short_desc", "full_desc"), [
        (code, name, name) for code, name in (
            ("PG", "Planned Giving"), ("PRG", "Principal Gifts"), ("FCG", "Foundation & Corporate Giving"),
            ("ASGP", "Annual & Special Gifts"), ("MG", "Major Gifts"))]),
    "tms_proposal_status": (("proposal_status_code", "short_desc"), [
        ("F", "Fulfilled"), ("O", "Open"), ("P", "Pending")]),
    "tms_proposal_stage": (("stage_code", "short_desc"), [
        ("RB", "Ask Planned"), ("AM", "Ask Made"), ("GC", "Gift Closed"), ("ST", "Gift/Pledge Stewardship"),
        ("PL", "PG Stewardship"), ("DN", "Declined"), ("DP", "Cancelled")]),
}


def _values_sql(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


def stage_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The source tables over the test tables in ``sf_dir``; every read is lazy, but for the row count of ``tasks``."""

    @cache
    def physical(name: str) -> DataFrame:
        if name == "m":
            price = F.col("o_totalprice").cast("decimal(18,2)")
            return physical("orders").groupBy(F.col("o_custkey").alias("m_custkey")).agg(F.max(price).alias("mx"))
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @cache
    def tasks(name: str) -> int:
        """Tasks for a join of the table ``name``, from its number of rows (which Parquet footers tell); 0: as Spark likes."""
        wanted = -(-physical(name).count() // ROWS_PER_TASK)
        return wanted if wanted > spark.sparkContext.defaultParallelism else 0

    def part(sources: tuple, condition: str | None, columns: dict[str, str], long_tasks: bool = False) -> DataFrame:
        (first, _), *others = sources
        df = physical(first)
        for name, on in others:
            other = physical(name)
            # adaptive execution goes by shuffled bytes alone, of which a row has few, and would put millions of rows into a task
            if long_tasks and tasks(first):
                key, other_key = on.split(" = ")
                df, other = df.repartition(tasks(first), key), other.repartition(tasks(first), other_key)
            df = df.join(other, F.expr(on), "left" if name == "m" else "inner")
        if condition:
            df = df.where(condition)
        typed = {c: e.replace("TIMESTAMP '", "TIMESTAMP_NTZ '") for c, e in columns.items()}
        return df.selectExpr(*[f"{e} AS {c}" for c, e in typed.items()])

    def read(table: str) -> DataFrame:
        if table in _LOOKUPS:
            return spark.sql(staged_sql(table))
        df = reduce(DataFrame.unionAll, [part(*entry, table in _LONG_TASKS) for entry in _MAPPING[table]])
        return df.distinct() if table == "assignment" else df

    return Tables(read)


def staged_sql(table: str) -> str:
    """The same table as a SELECT over the test tables."""
    if table in _LOOKUPS:
        columns, rows = _LOOKUPS[table]
        return f"SELECT * FROM (VALUES {_values_sql(rows)}) AS v({', '.join(columns)})"
    selects = []
    for (first, _), *others in [entry[0] for entry in _MAPPING[table]]:
        source = first
        for name, on in others:
            if name == "m":
                inner = f"SELECT o_custkey AS m_custkey, MAX({_money('o_totalprice')}) AS mx FROM orders GROUP BY 1"
                source += f" LEFT JOIN ({inner}) AS m ON {on}"
            else:
                source += f" JOIN {name} ON {on}"
        selects.append(source)
    parts = []
    for source, (_, condition, columns) in zip(selects, _MAPPING[table]):
        listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        distinct = "DISTINCT " if table == "assignment" else ""
        where = f" WHERE {condition}" if condition else ""
        parts.append(f"SELECT {distinct}{listed} FROM {source}{where}")
    return " UNION ALL ".join(parts)


def with_staged(sql: str) -> str:
    """``sql`` behind a WITH prelude of the source tables it names."""
    used = [t for t in TABLE_NAMES if re.search(rf"\b{t}\b", sql)]
    prelude = ",\n".join(f"{t} AS ({staged_sql(t)})" for t in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {prelude},\n{body[5:]}"
    return f"WITH {prelude}\n{body}"
