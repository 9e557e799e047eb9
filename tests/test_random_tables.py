"""Reports and aggregates against row-by-row SQL on random tables with repeated keys, nulls and ties."""

from __future__ import annotations

import duckdb
import pytest
from random_tables import TABLE_NAMES, random_tables, write

from prospectus import checks  # noqa: F401
from prospectus.checks.registry import registered
from prospectus.sources.staged import STAGED_PARAMS
from prospectus.sources.tables import load_tables

KEYS = (
    "agg_contacts_rm_all", "agg_contacts_officer_window", "agg_contacts_any_window", "agg_contacts_pm",
    "agg_giving_window", "agg_proposals", "agg_visits_to_ask", "agg_stage_days", "agg_outside_visits",
    "cohort_proposals", "win_time_at_stage_proposal", "sub_max_ask_date", "report_portfolio_percents",
    "report_om_visits", "report_om_prospects", "report_proposal_stats", "report_portfolio_analysis",
    "report_scorecard_rm", "report_scorecard_tm",
)


@pytest.fixture(scope="module", params=[2, 11])
def sources(request, spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp(f"seed{request.param}"))
    write(random_tables(request.param), root)
    duck = duckdb.connect()
    for name in TABLE_NAMES:
        duck.execute(f"CREATE TABLE {name} AS SELECT * FROM read_parquet('{root}/{name}')")
    return load_tables(spark, root), duck


@pytest.mark.parametrize("key", KEYS)
def test_matches_row_by_row_sql(sources, key):
    t, duck = sources
    query, sql = registered()[key]
    df = query(t, STAGED_PARAMS)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in order)) for row in cursor.fetchall())
    assert len(names) == len(columns)
    assert found == expected
