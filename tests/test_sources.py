from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from random_tables import random_tables, write

from prospectus import plans
from prospectus.params import ReportParams, window_label
from prospectus.plans import labels
from prospectus.plans.percents import coverage_by_officer
from prospectus.sources.schemas import TABLE_NAMES, schema_of
from prospectus.sources.staged import STAGED_PARAMS, stage_tables
from prospectus.sources.tables import Tables, conform, load_tables, tables_from_catalog, write_bucketed, write_report, write_tables

SMALL = "/root/testdata/sf0.001"


def test_staged_tables_have_the_declared_types(spark):
    t = stage_tables(spark, SMALL)
    for name in TABLE_NAMES:
        found = [(f.name, f.dataType) for f in getattr(t, name).schema]
        assert found == [(f.name, f.dataType) for f in schema_of(name)]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="prospect lacks .*stop_date"):
        conform(spark.range(1).withColumnRenamed("id", "prospect_id"), "prospect")


def test_unknown_table(spark):
    with pytest.raises(AttributeError):
        stage_tables(spark, SMALL).no_such_table


def test_conform_keeps_typed_columns_and_casts_others(spark):
    values = {"PROSPECT_ID": "7", "id_number": "", "primary_ind": "Y"}
    raw = spark.range(1).select(*[F.lit(v).alias(c) for c, v in values.items()])
    row = conform(raw, "prospect_entity", empty_as_null=True).first()
    assert (row.prospect_id, row.id_number, row.primary_ind) == (7, None, "Y")


def test_text_tables_are_read_with_the_declared_schema(spark, tmp_path):
    bridge = stage_tables(spark, SMALL).prospect_entity
    bridge.write.option("header", True).csv(str(tmp_path / "prospect_entity"))
    read = load_tables(spark, str(tmp_path), "csv", header="true").prospect_entity
    assert read.schema.simpleString() == schema_of("prospect_entity").simpleString()
    assert read.exceptAll(bridge).isEmpty() and read.count() == bridge.count()


def test_written_tables_give_the_same_report(spark, tmp_path):
    write(random_tables(4), str(tmp_path))
    t = load_tables(spark, str(tmp_path))
    write_tables(t, str(tmp_path / "again"))
    again = load_tables(spark, str(tmp_path / "again"))
    first = plans.portfolio_percents(t, STAGED_PARAMS).collect()
    assert plans.portfolio_percents(again, STAGED_PARAMS).collect() == first


def test_catalog_tables(spark, tmp_path):
    write(random_tables(4), str(tmp_path))
    for name in ("prospect", "contact_report"):
        spark.read.parquet(f"{tmp_path}/{name}").createOrReplaceTempView(name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS portfolio_test LOCATION '{tmp_path}/db'")
    try:
        for name in ("prospect", "contact_report"):
            spark.sql(f"CREATE TABLE portfolio_test.{name} USING parquet LOCATION '{tmp_path}/{name}'")
        t = tables_from_catalog(spark, "portfolio_test")
        assert plans.prospects_added(t, STAGED_PARAMS).first().prospects_added >= 0
    finally:
        spark.sql("DROP DATABASE portfolio_test CASCADE")
        for name in ("prospect", "contact_report"):
            spark.catalog.dropTempView(name)


@pytest.fixture
def catalog(spark, tmp_path):
    """A schema of its own, with the settings under which nothing is broadcast and bucketed sides stay where they are."""
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.enabled": "false"}
    spark.sql(f"CREATE DATABASE bucketed_test LOCATION '{tmp_path}/db'")
    yield lambda: [spark.conf.set(*setting) for setting in settings.items()]
    for name in settings:
        spark.conf.unset(name)
    spark.sql("DROP DATABASE bucketed_test CASCADE")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path, catalog):
    """The same report; the reports' counts meet the cohort where both are stored."""
    write(random_tables(4), str(tmp_path))
    plain = load_tables(spark, str(tmp_path))
    stored = write_bucketed(plain, "bucketed_test", 3)
    assert {"assignment", "contact_report", "proposal", "stage"} <= set(stored) and "ucdr_giving" not in stored
    t = tables_from_catalog(spark, "bucketed_test")
    for name in ("contact_report", "ucdr_giving", "ucdr_prospect_pool"):
        assert getattr(t, name).exceptAll(getattr(plain, name)).isEmpty() and getattr(t, name).count() == getattr(plain, name).count()
    assert plans.portfolio_percents(t, STAGED_PARAMS).collect() == plans.portfolio_percents(plain, STAGED_PARAMS).collect()
    catalog()
    reports = t.contact_report.groupBy("prospect_id", "author_id_number").agg(F.count("*").alias("n"))
    officers = t.assignment.groupBy("prospect_id", "assignment_id_number").agg(F.count("*").alias("rows"))
    joined = reports.join(officers.withColumnRenamed("assignment_id_number", "author_id_number"), ["prospect_id", "author_id_number"])
    text = joined.groupBy("prospect_id").agg(F.sum(F.col("n") * F.col("rows")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "SortMergeJoin" in text

    # the coverage report: only the cohort moves, as it is first joined to the staff list by officer; it is used three times
    planned = [coverage_by_officer(x, STAGED_PARAMS)._jdf.queryExecution().executedPlan().toString() for x in (t, plain)]
    by_prospect = [len(re.findall(r"Exchange hashpartitioning\(prospect_id", text)) for text in planned]
    assert by_prospect[0] == 3 < by_prospect[1]
    lines = planned[0].splitlines()
    scan = next(i for i, line in enumerate(lines) if "bucketed_test.contact_report" in line)
    join = max(i for i in range(scan) if "SortMergeJoin" in lines[i])
    assert not any("Exchange" in line for line in lines[join:scan])


def test_crowded_keys_are_not_bucketed(spark, tmp_path, catalog):
    """A third of all reports on one prospect would be one task's: such a table keeps its date order."""
    write(random_tables(4), str(tmp_path))
    plain = load_tables(spark, str(tmp_path))
    hot = plain.contact_report.limit(1).crossJoin(spark.range(2_000).drop("id"))
    tables = Tables(lambda name: plain.contact_report.unionByName(hot) if name == "contact_report" else getattr(plain, name))
    stored = write_bucketed(tables, "bucketed_test", 16, least_rows=1_000)
    assert "contact_report" not in stored and "assignment" in stored
    assert spark.table("bucketed_test.contact_report").count() == tables.contact_report.count()


def test_report_is_written_under_display_names(spark, tmp_path):
    t = stage_tables(spark, SMALL)
    report = labels.with_labels(plans.portfolio_percents(t, STAGED_PARAMS), labels.PERCENTS)
    write_report(report, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).columns[:4] == [
        "RM_NAME", "Portfolio Size", "Contacted by RM", "% Contacted by RM"]


@pytest.mark.parametrize("atype", ["LM", "S"])
def test_every_scorecard_label_names_a_column(spark, atype):
    card = plans.officer_scorecard(stage_tables(spark, SMALL), STAGED_PARAMS, atype)
    names = labels.scorecard_labels(atype)
    shown = labels.with_labels(card, names).columns
    assert set(names) <= set(card.columns) and len(set(shown)) == len(card.columns) == 100
    assert sorted(c for c in card.columns if c not in names) == ["office", "pm_size", "pq_size", "unit"]


def test_labels_of_other_reports_name_columns(spark):
    t, p = stage_tables(spark, SMALL), STAGED_PARAMS
    pairs = [(plans.portfolio_analysis, labels.ANALYSIS), (plans.om_proposals, labels.OM_PROPOSALS),
             (plans.om_prospects, labels.OM_PROSPECTS), (plans.om_visits, labels.OM_VISITS),
             (plans.proposal_stats, labels.PROPOSAL_STATS), (plans.portfolio_percents, labels.PERCENTS)]
    for report, names in pairs:
        assert set(names) <= set(report(t, p).columns)


def test_default_parameters():
    p = ReportParams()
    assert window_label(p.window) == "7/1/2015 - 6/30/2017"
    assert window_label(p.om_window) == "7/1/2015 - 5/15/2017"


@pytest.mark.parametrize("day", ["timestamp_ntz '2016-07-01 00:00:00'", "CAST(NULL AS timestamp_ntz)"])
def test_one_date_spreads_over_files(spark, tmp_path, day):
    gifts = spark.range(4_000).selectExpr(
        "'1' AS id_number", f"{day} AS date_of_record", "CAST(id AS decimal(18,2)) AS prim_amt", "'G' AS giving_ind",
        "'1' AS prog_hier_num")
    empty = stage_tables(spark, SMALL)
    tables = Tables(lambda name: gifts if name == "ucdr_giving" else getattr(empty, name).limit(0))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_tables(tables, str(tmp_path / "stored"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "stored/ucdr_giving")).groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2_000 and sum(sizes) == 4_000


def test_tasks_of_the_stage_history_take_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    lines = spark.range(6_000).selectExpr("id % 2000 AS l_orderkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber", "TIMESTAMP_NTZ '1996-03-01 00:00:00' AS l_shipdate")
    orders = spark.range(2_000).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey")
    for name, df in {"lineitem": lines, "orders": orders, "customer": spark.range(50).selectExpr("id AS c_custkey")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    plain = sorted(map(str, stage_tables(spark, str(tmp_path)).stage.collect()))
    monkeypatch.setattr("prospectus.sources.staged.ROWS_PER_TASK", 100)
    stage = stage_tables(spark, str(tmp_path)).stage
    tasks = stage.where("proposal_id IS NOT NULL").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 40 and max(row["count"] for row in tasks) < 400
    assert sorted(map(str, stage.collect())) == plain and len(plain) == 6_050
