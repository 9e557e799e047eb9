"""Small source tables full of collisions, nulls, unknown keys and window edges."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import types as T

from prospectus.sources.schemas import TABLE_NAMES, schema_of
from prospectus.sources.staged import _LOOKUPS

PROSPECTS = list(range(1, 13))
STAFF = [f"90000000{i:02d}" for i in range(1, 10)]
ENTITIES = [f"{i:010d}" for i in range(1, 15)]
PROPOSALS = list(range(100, 140))
EDGES = [
    datetime(1998, 7, 1), datetime(1999, 6, 30), datetime(1999, 6, 30, 12), datetime(2000, 6, 30),
    datetime(2000, 6, 30, 10), datetime(2000, 5, 15), datetime(2000, 5, 15, 1), datetime(2000, 7, 1),
    datetime(2000, 7, 2), datetime(2001, 8, 2), datetime(2001, 8, 2, 0, 0, 1), datetime(1998, 6, 30, 23, 59),
]
CODES = {
    "active_ind": ["Y", "Y", "Y", "N"],
    "prim_prosp_ind": ["Y", "Y", "N"],
    "primary_ind": ["Y", "Y", "N"],
    "plan_gift_ind": ["Y", "N"],
    "pers_org_ind": ["P", "P", "P", "O"],
    "assignment_type": ["LM", "LM", "S", "S", "SL"],
    "priority_code": ["PQ", "PM", "PX"],
    "staff_type_code": ["DEV", "DEV", "DEV", "ADM"],
    "unit_code": ["PG", "PRG", "FCG", "ASGP", "MG"],
    "office_code": ["0", "1", "2"],
    "contact_type": ["V", "V", "C", "P", "S", "1", "X"],
    "contact_initiated_by": ["FCGS", "DO"],
    "contact_purpose_code": ["A", "A", "B", "C"],
    "contact_outcome": ["QU", "NN", "DQ", "DD", "NR", "DU", "QO", " "],
    "proposal_type": ["MGL", "MGS", "MGP", "AF"],
    "proposal_status_code": ["F", "O", "P"],
    "giving_ind": ["G", "P", "M"],
    "prog_hier_num": ["1", "2"],
}
AMOUNTS = [0, 0, 1000, 25000, 49999.99, 50000, 99999, 100000, 999999, 1000000, 1500000]


def random_tables(seed: int) -> dict[str, list[dict]]:
    rng = random.Random(seed)

    def date() -> datetime:
        if rng.random() < 0.3:
            return rng.choice(EDGES)
        return datetime(1997, 1, 1) + timedelta(days=rng.randrange(1700), hours=rng.choice([0, 0, 0, 13]))

    def value(table: str, column: str, kind: T.DataType):
        if rng.random() < 0.08:
            return None
        if column == "stage_code":
            prospect_stage = table == "prospect" or (table == "stage" and rng.random() < 0.5)
            return rng.choice(["Q", "CU", "SO", "ST", "PL", "PS"] if prospect_stage else
                              ["RB", "AM", "GC", "ST", "PL", "DN", "DP"])
        if column in CODES:
            return rng.choice(CODES[column])
        if column in ("prospect_id", "prosp_id"):
            return rng.choice([*PROSPECTS, 99])
        if column in ("assignment_id_number", "author_id_number"):
            return rng.choice([*STAFF, "9999999999"])
        if column == "proposal_id":
            return rng.choice([*PROPOSALS, 999])
        if column == "id_number":
            return rng.choice(ENTITIES)
        if isinstance(kind, T.TimestampNTZType):
            return date()
        if isinstance(kind, T.DecimalType):
            return Decimal(str(rng.choice(AMOUNTS))).quantize(Decimal("0.01"))
        if isinstance(kind, (T.LongType, T.IntegerType)):
            return rng.randrange(1000)
        return f"{column} {rng.randrange(4)}"

    keys = {"prospect": ("prospect_id", PROSPECTS), "staff": ("id_number", STAFF), "ucdr_bio": ("id_number", [*STAFF[:-2], *STAFF[:2], STAFF[1]]),
            "proposal": ("proposal_id", PROPOSALS), "ucdr_prospect_pool": ("id_number", ENTITIES)}
    sizes = {"assignment": 260, "contact_report": 700, "stage": 200, "prospect_entity": 18, "ucdr_giving": 160}
    tables = {}
    for table in TABLE_NAMES:
        if table in _LOOKUPS:
            columns, rows = _LOOKUPS[table]
            tables[table] = [dict(zip(columns, row)) for row in rows]
            continue
        if table == "tms_office":
            tables[table] = [{"office_code": c, "short_desc": f"Office {c}"} for c in ("0", "1")]
            continue
        key, values = keys.get(table, (None, range(sizes.get(table, 0))))
        tables[table] = []
        for n in values:
            row = {f.name: value(table, f.name, f.dataType) for f in schema_of(table)}
            if key:
                row[key] = n
            if table == "staff":
                row["sort"] = f"Officer {n}"
            tables[table].append(row)
    # The date of the second copy of a report ties with the first.
    tables["contact_report"] += rng.sample(tables["contact_report"], 20)
    tables["stage"] += rng.sample(tables["stage"], 20)
    for row in tables["assignment"]:
        if row["assignment_type"] != "SL" and rng.random() < 0.8:
            row["proposal_id"] = None
    for row in tables["proposal"]:
        if rng.random() < 0.7:
            row["date_added"] = row["start_date"]
    for row in tables["contact_report"]:
        row["report_id"] = row["report_id"] or 1
    return tables


_ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(),
          T.TimestampNTZType: pa.timestamp("us"), T.DecimalType: pa.decimal128(18, 2)}


def arrow_table(table: str, rows: list[dict]) -> pa.Table:
    schema = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in schema_of(table)])
    return pa.Table.from_pylist(rows, schema=schema)


def write(tables: dict[str, list[dict]], root: str) -> None:
    for name in TABLE_NAMES:
        pq.write_table(arrow_table(name, tables.get(name, [])), f"{root}/{name}")
