"""Every operator and report as a query over the test tables, next to SQL that computes the same result."""

from prospectus.checks import aggregates, cohorts, filters, joins, reports, scalars, scans, windows  # noqa: F401
from prospectus.checks.registry import check_sql, queries

__all__ = ["check_sql", "queries"]
