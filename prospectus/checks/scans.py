"""Scans of the source tables that hold data; the lookup tables are input of the joins."""

from __future__ import annotations

from prospectus.checks.registry import register
from prospectus.sources.schemas import TABLE_NAMES


def _scan(table: str) -> None:
    register(f"scan_{table}", lambda t, p: getattr(t, table), f"SELECT * FROM {table}")


#: Their rows are written in the staging code, not read from a given table.
WRITTEN_LOOKUPS = ("tms_stage", "tms_unit_code", "tms_proposal_status", "tms_proposal_stage")

for _table in TABLE_NAMES:
    if _table not in WRITTEN_LOOKUPS:
        _scan(_table)
