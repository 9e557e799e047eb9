"""Hot keys: exact results where the row-by-row form would build hundreds of millions of rows."""

from __future__ import annotations

import bisect
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from random_tables import random_tables, write

from prospectus import plans
from prospectus.operators.fan_out import crowded_keys, deal_out, fan_out_join
from prospectus.operators.ranking import latest_by, with_next_event
from prospectus.params import ReportParams
from prospectus.plans import portfolio_percents
from prospectus.plans.scorecard import officer_scorecard
from prospectus.sources.staged import STAGED_PARAMS
from prospectus.sources.tables import load_tables

P = ReportParams(as_of=datetime(2017, 8, 1))
OFFICERS = 400


@pytest.fixture
def crowded(tables):
    """One prospect held by 400 officers, half PQ and half PM; every other officer filed two visits."""
    ids = [f"{i:010d}" for i in range(OFFICERS)]
    held = [{"prospect_id": 1, "assignment_id_number": who, "assignment_type": kind, "active_ind": "Y",
             "priority_code": "PQ" if i < OFFICERS // 2 else "PM"} for kind in ("LM", "S") for i, who in enumerate(ids)]
    visits = [{"report_id": 1, "prospect_id": 1, "author_id_number": who, "contact_type": "V", "contact_outcome": "QU",
               "contact_date": datetime(2017, 5, 1)} for who in ids[::2] for _ in range(2)]
    return tables(
        prospect=[{"prospect_id": 1, "active_ind": "Y", "stage_code": "Q"}],
        staff=[{"id_number": who, "sort": who, "staff_type_code": "DEV", "active_ind": "Y"} for who in ids],
        assignment=held, contact_report=visits)


def test_manager_scorecard_of_a_crowded_prospect(crowded):
    card = officer_scorecard(crowded, P).collect()
    assert len(card) == OFFICERS
    main, priority = OFFICERS // 2 + 1, OFFICERS // 4 + 1
    for row in card:
        assert row.visited_by_officer == (main - 1) * priority * priority
        assert row.visited_any == main * priority * priority
        assert row.total_to_be_qualified == 1
    assert {r.pq_visited for r in card if r.pq_size} == {(priority - 1) * main * priority}


def test_team_scorecard_of_a_crowded_prospect(crowded):
    card = officer_scorecard(crowded, P, "S").collect()
    priority = OFFICERS // 4 + 1
    assert sorted({r.visited_by_officer for r in card}) == [0, priority * priority]
    assert {r.visit_quartile for r in card} == {"75%+"}


def test_coverage_of_a_crowded_prospect(crowded):
    rows = portfolio_percents(crowded, P).collect()
    authors = OFFICERS // 2 + 1
    assert {(r.visited_by_rm, r.visited_by_anyone) for r in rows} == {(authors * (authors - 1), authors * authors)}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_fan_out_join_is_the_plain_join_in_parts(spark, how):
    rng = random.Random(3)
    keys = [1] * 60 + [2, 2, 3, None, 4]
    first = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k int, a int")
    second = spark.createDataFrame([(k, rng.randrange(9)) for k in [1] * 40 + [2, 3, 3, 5, None]], "k int, b int")
    third = spark.createDataFrame([(k, rng.randrange(9)) for k in [1, 1, 2]], "k int, c int")
    crowded = crowded_keys("k", first, second, third, rows_per_part=500, how=how).collect()
    assert [tuple(r) for r in crowded] == [(1, 10)]
    parts = deal_out(first, crowded_keys("k", first, second, third, rows_per_part=500, how=how), "k").where("k = 1")
    assert parts.select("_part").distinct().count() > 5
    split = fan_out_join(first, second, third, key="k", how=how, rows_per_part=500)
    plain = first.join(second, "k", how).join(third, "k", how)
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_a_key_that_one_side_lacks_is_dealt_out(spark):
    first = spark.range(100).selectExpr("1 AS k", "id AS a")
    second = spark.range(100).selectExpr("1 AS k", "id AS b")
    third = spark.range(1).selectExpr("2 AS k", "id AS c")
    crowded = crowded_keys("k", first, second, third, rows_per_part=500)
    assert [tuple(r) for r in crowded.collect()] == [(1, 20)]
    assert crowded_keys("k", first, second, third, rows_per_part=500, how="inner").count() == 0


@pytest.mark.parametrize("report", ["portfolio_analysis", "om_prospects", "om_proposals", "proposal_stats"])
def test_reports_are_the_same_in_parts(spark, tmp_path, report):
    write(random_tables(11), str(tmp_path))
    t = load_tables(spark, str(tmp_path))
    whole, parts = (
        sorted(map(str, getattr(plans, report)(t, replace(STAGED_PARAMS, rows_per_part=n)).collect()))
        for n in (10**6, 3)
    )
    assert whole == parts and whole


@pytest.mark.parametrize("include_self", [True, False])
def test_next_event_agrees_with_a_search(spark, include_self):
    rng = random.Random(7)
    points = set()
    for _ in range(900):
        key = 0 if rng.random() < 0.5 else rng.randrange(1, 8)
        at = datetime(2016, 1, 1) + timedelta(days=rng.randrange(40), seconds=rng.choice([0, 1, 3600]))
        points.add((key, at, at if rng.random() < 0.6 else None))
    if not include_self:  # strictly later needs one row per (key, time)
        points = {(k, a): (k, a, e) for k, a, e in sorted(points, key=str)}.values()
    df = spark.createDataFrame(list(points), "k int, at timestamp_ntz, event timestamp_ntz")
    events: dict[int, list[datetime]] = {}
    for key, _, event in points:
        if event:
            events.setdefault(key, []).append(event)
    find = bisect.bisect_left if include_self else bisect.bisect_right
    for row in with_next_event(df, ["k"], "at", "event", "next", include_self).collect():
        known = sorted(events.get(row.k, []))
        place = find(known, row["at"])
        assert row["next"] == (known[place] if place < len(known) else None)


def test_latest_by_ranks_null_first_and_breaks_ties(spark):
    rows = [(1, None, "b"), (1, 5, "z"), (2, 5, "a"), (2, 5, "c"), (3, 1, None), (None, 9, "x")]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    found = {r.k: r.v for r in latest_by(df, ["k"], "o", ["v"]).collect()}
    assert found == {1: "b", 2: "c", 3: None}
    hot = spark.range(20_000, numPartitions=8).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    assert latest_by(hot, ["k"], "o").first().o == 19_999


def test_next_event_deals_days_out_to_all_shuffle_partitions(spark):
    rows = [(k, datetime(2016, 1, 1) + timedelta(days=d)) for k in range(40) for d in range(10)]
    points = spark.createDataFrame([(k, at, at) for k, at in rows], "k int, at timestamp_ntz, event timestamp_ntz")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = with_next_event(points, ["k"], "at", "event", "next", False).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({row.task for row in found}) == 16
    assert {(row.k, row["at"], row["next"]) for row in found} == {(k, at, at + timedelta(days=1) if (k, at + timedelta(days=1)) in set(rows) else None) for k, at in rows}
