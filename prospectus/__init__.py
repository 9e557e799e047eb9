"""Fundraising-portfolio analytics as PySpark DataFrame functions."""

from prospectus.params import ReportParams
from prospectus.sources.tables import Tables, load_tables, tables_from_catalog

__all__ = ["ReportParams", "Tables", "load_tables", "tables_from_catalog"]
