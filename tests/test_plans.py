"""Physical plans: what is scanned, pushed down, shuffled and joined."""

from __future__ import annotations

import re
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from random_tables import random_tables, write

from prospectus import plans
from prospectus.checks.aggregates import COUNT_COLUMNS, scorecard_counts
from prospectus.operators import contacts, fan_out, giving, stages
from prospectus.operators.cohorts import proposal_cohort
from prospectus.plans import scorecard
from prospectus.plans.scorecard import officer_scorecard
from prospectus.sources.shared import shared_folder
from prospectus.sources.staged import STAGED_PARAMS as P
from prospectus.sources.tables import load_tables

REPORTS = {
    "percents": plans.portfolio_percents,
    "analysis": plans.portfolio_analysis,
    "added": plans.prospects_added,
    "dropped_nn_dq": plans.dropped_nn_dq,
    "om_proposals": plans.om_proposals,
    "om_prospects": plans.om_prospects,
    "om_visits": plans.om_visits,
    "proposal_stats": plans.proposal_stats,
    "scorecard_rm": lambda t, p: officer_scorecard(t, p, "LM"),
    "scorecard_tm": lambda t, p: officer_scorecard(t, p, "S"),
}


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    write(random_tables(5), root)
    return load_tables(spark, root)


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans_of(monkeypatch):
    """Plans of a report: of the tables it stores on the way, and of its result."""
    store = DataFrame.checkpoint

    def planned(report, t, p=P) -> list[str]:
        texts = []
        with monkeypatch.context() as patch:
            patch.setattr(DataFrame, "checkpoint", lambda df, *args: texts.append(plan_of(df)) or store(df, *args))
            result = report(t, p)
        return [*texts, plan_of(result)]

    return planned


@pytest.mark.parametrize("name", REPORTS)
def test_no_python_and_no_quadratic_joins(t, name, no_broadcast, plans_of):
    text = "\n".join(plans_of(REPORTS[name], t))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert operator not in text


FANNED_OUT = {"analysis": 3, "om_proposals": 2, "om_prospects": 2, "proposal_stats": 3}


@pytest.mark.parametrize("name", REPORTS)
def test_only_lists_of_crowded_keys_are_broadcast(t, name, no_broadcast, plans_of):
    """One for each side of a fan-out join where there are crowded keys, none otherwise."""
    for p, expected in ((P, 0), (replace(P, rows_per_part=1), FANNED_OUT.get(name, 0))):
        assert sum(text.count("BroadcastHashJoin") for text in plans_of(REPORTS[name], t, p)) == expected


def test_a_long_list_of_crowded_keys_is_not_broadcast(t, no_broadcast, plans_of, monkeypatch):
    monkeypatch.setattr(fan_out, "BROADCAST_KEYS", 0)
    texts = plans_of(plans.portfolio_analysis, t, replace(P, rows_per_part=1))
    assert not any("BroadcastHashJoin" in text for text in texts)


def test_no_full_outer_join(t, no_broadcast, plans_of):
    for report in REPORTS.values():
        assert not any("FullOuter" in text for text in plans_of(report, t))


def test_proposal_stats_scan_proposals_once_and_their_keys_once(t, no_broadcast, plans_of):
    lines = "\n".join(plans_of(plans.proposal_stats, t)).splitlines()
    reads = [line for line in lines if re.search(r"FileScan parquet .*/proposal\]", line)]
    assert len(reads) == 2 and len([line for line in reads if "proposal_title" in line]) == 1
    assert all("ask_amt" not in line for line in reads if "proposal_title" not in line)


def scans(text: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet .*/{table}\]", text))


# Shuffles and scans planned at most, stored tables included, before Spark reuses any at run time.
PLANNED = {
    "percents": (22, {"contact_report": 1, "assignment": 4}),
    "analysis": (30, {"contact_report": 2, "assignment": 1, "proposal": 1}),
    "om_proposals": (11, {"assignment": 1}),
    "om_prospects": (33, {"contact_report": 2, "assignment": 2}),
    "om_visits": (16, {"contact_report": 1, "assignment": 2}),
    "proposal_stats": (31, {"proposal": 2, "assignment": 2, "stage": 2}),
    "scorecard_rm": (45, {"contact_report": 1, "stage": 1, "assignment": 3}),
    "scorecard_tm": (45, {"contact_report": 1, "stage": 1, "assignment": 3}),
}


@pytest.mark.parametrize("name", PLANNED)
def test_reports_plan_their_work_once(t, spark, name, no_broadcast, plans_of):
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "false")  # its own reads are not the report's
    try:
        texts = plans_of(REPORTS[name], t)
    finally:
        spark.conf.unset("spark.sql.optimizer.runtime.bloomFilter.enabled")
    shuffles, reads = PLANNED[name]
    assert sum(text.count("Exchange hashpartitioning") for text in texts) <= shuffles
    for table, most in reads.items():
        assert sum(scans(text, table) for text in texts) <= most, table


def test_shared_tables_need_a_folder_on_a_cluster(spark, monkeypatch):
    session = SimpleNamespace(sparkContext=SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_window_and_type_filters_reach_the_scan(t, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(contact_date", plan_of(contacts.activity_tallies(t, P)))
    assert "In(contact_type" in plan_of(contacts.coverage_tallies(t, P))


def test_only_needed_columns_are_read(t):
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan_of(giving.last_gift(t))).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["date_of_record", "giving_ind", "id_number"]


def test_latest_rows_are_limited_before_the_shuffle(t):
    text = plan_of(giving.last_annual_fund_gift(t))
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


def test_last_gift_needs_no_sort(t):
    text = plan_of(giving.last_gift(t))
    assert "Sort" not in text and "partial_max" in text


@pytest.mark.parametrize("table", ["contact_report", "stage", "ucdr_giving"])
@pytest.mark.parametrize("name", REPORTS)
def test_events_are_reduced_before_they_are_joined(t, name, table, no_broadcast, plans_of):
    """Going up from every scan of an event table, an aggregate or a per-key limit comes before the first join."""
    for lines in map(str.splitlines, plans_of(REPORTS[name], t)):
        for at in [i for i, line in enumerate(lines) if re.search(rf"FileScan parquet .*/{table}\]", line)]:
            above = [line for line in reversed(lines[:at]) if re.search("Aggregate|WindowGroupLimit|Join", line)]
            assert "Join" not in above[0]


def test_next_stage_search_is_split_by_day(t, no_broadcast):
    text = plan_of(stages.proposal_stage_intervals(t))
    assert re.search(r"hashpartitioning\(proposal_id#\w+, _day#\w+", text)


def test_proposal_rows_are_not_made_distinct(t, no_broadcast):
    """The full-width rows pass no aggregate: nothing groups by the proposal title."""
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*proposal_title", plan_of(proposal_cohort(t, P)))


def test_stage_history_is_not_joined_to_itself(t, no_broadcast):
    """One scan for the dates, one for the first date of each day."""
    text = plan_of(stages.stage_days(t, P))
    assert scans(text, "stage") == 2 and text.count("SortMergeJoin") == 1


def test_both_scorecards_read_the_large_tables_once(spark, tmp_path, monkeypatch):
    write(random_tables(5), str(tmp_path))
    t, read = load_tables(spark, str(tmp_path)), []
    for name in ("window_activity", "newest_entries"):
        monkeypatch.setattr(scorecard, name, lambda *a, name=name, f=getattr(scorecard, name): read.append(name) or f(*a))
    both = sorted(map(str, scorecard_counts(t, P).collect()))
    assert sorted(read) == ["newest_entries", "window_activity"]
    alone = [scorecard.officer_scorecard(t, P, role).selectExpr(f"'{role}' AS role", "officer_id", *COUNT_COLUMNS) for role in ("LM", "S")]
    assert both == sorted(map(str, alone[0].unionByName(alone[1]).collect())) and both
