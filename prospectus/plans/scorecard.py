"""Officer scorecard: a hundred measures per officer, for managers ("LM") or team members ("S").

In the published query every cohort row meets all author rows of its prospect three times over (all, PQ and PM
reports), and the officer's counts run over the product. Here each prospect is reduced to one row that says how many
rows it contributes to each join and how many of them satisfy each test. An officer's count is then the sum over its
cohort rows of tests met times the other joins' row counts. The numbers are the same, and no product is ever built,
however many officers a prospect has.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectus.functions import predicates as is_
from prospectus.functions import scalars
from prospectus.functions.dates import now
from prospectus.operators.cohorts import cohort_pairs, prospect_cohort
from prospectus.operators.contacts import activity_of, by_cohort_officer, outside_entities, window_activity
from prospectus.operators.giving import primary_pool, prospect_giving
from prospectus.operators.officers import (
    AGED_PROPOSAL_STAGES,
    AGED_STAGES,
    age_counts,
    officer_portfolio,
    role_size,
)
from prospectus.operators.proposals import HISTORY_CODES, prospect_proposals
from prospectus.operators.stages import newest_entries
from prospectus.params import ReportParams, window_label
from prospectus.sources.shared import shared
from prospectus.sources.tables import Tables

# Tests on one author row of a prospect, as measure name -> (tally, least value that counts).
OWN_TESTS = {
    "ask_major_by_officer": ("ask", 1),
    "ask_any_by_officer": ("ask_or_special", 1),
    "ask_special_by_officer": ("special", 1),
    "contacted_by_officer": ("contacts", 1),
    "visited_by_officer": ("visits", 1),
    "visited_twice_by_officer": ("visits", 2),
    "documented_strategy": ("strategy", 1),
    "dq_nn_nr_reports": ("dq_nn_nr", 1),
    "qualified_reports": ("qu", 1),
}
# The same over all authors of a prospect.
ANY_TESTS = {
    "ask_major_any": "ask",
    "ask_any_any": "ask_or_special",
    "ask_special_any": "special",
    "contacted_any": "contacts",
    "visited_any": "visits",
}
# Capacity thresholds.
CAPACITY_STEPS = {"50k": 50_000, "100k": 100_000, "1m": 1_000_000}
CAPACITY_TESTS = {f"rated_{side}_{step}": (side, least) for step, least in CAPACITY_STEPS.items() for side in ("lt", "ge")}
PRIORITIES = {"pq": "PQ", "pm": "PM"}
PROPOSAL_SUMS = {
    "proposals": "proposals",
    "proposals_ask_made": "ask_made",
    "proposals_dropped_before_ask": "dropped_before_ask",
    "proposals_closed": "closed",
}
# Prospect stages shown, with the officer count each reads and whether a "1+ year" share follows.
STAGE_MIX = {
    "at_qualification": ("n_q", True),
    "at_cultivation": ("n_cu", True),
    "at_active_solicitation": ("n_so", True),
    "at_stewardship": ("n_st", False),
    "at_pg_stewardship": ("n_pl", False),
    "at_permanent_stewardship": ("n_ps", False),
}


def _own_test(tally: str, least: int) -> str:
    """Cohort rows repeat the officer's reports, so a prospect held twice reaches two visits with one report."""
    return f"rows * {tally} >= {least}"


def _named(expressions: dict[str, str]) -> list[Column]:
    return [F.expr(sql).alias(name) for name, sql in expressions.items()]


def author_summary(pairs: DataFrame, tallies: DataFrame) -> DataFrame:
    """Per prospect: authors that are cohort officers, those that pass each test, and flags over all authors."""
    filed = tallies.join(pairs.withColumnRenamed("officer_id", "author_id"), ["prospect_id", "author_id"], "left")
    counts = {"filed": "count(rows)"}
    counts |= {name: f"count_if({_own_test(*test)})" for name, test in OWN_TESTS.items()}
    for name in PRIORITIES:
        held = f"{name}_rows > 0"
        counts[f"{name}_filed"] = f"count_if({held})"
        counts[f"{name}_visited"] = f"count_if({held} AND visits > 0)"
        counts[f"{name}_qualified"] = f"count_if({held} AND qualified > 0)"
    counts |= {name: f"max({tally} > 0)" for name, tally in ANY_TESTS.items()}
    return filed.groupBy("prospect_id").agg(*_named(counts))


def capacity_summary(t: Tables) -> DataFrame:
    """Per prospect: primary pool rows, in all and by capacity threshold."""
    counts = {"pool_rows": "count(*)"}
    for name, (side, least) in CAPACITY_TESTS.items():
        counts[name] = f"count_if(abs_high_capacity_ucdt_asks {'<' if side == 'lt' else '>='} {least})"
    return primary_pool(t).groupBy("prospect_id").agg(*_named(counts))


def prospect_summary(
    pairs: DataFrame, tallies: DataFrame, t: Tables, p: ReportParams, entries: DataFrame | None = None
) -> DataFrame:
    """One row per cohort prospect with everything an officer's counts need of it."""
    officers = {"officers": "count(*)", "prospect_rows": "sum(rows)"}
    officers |= {f"{name}_officers": f"count_if({name}_rows > 0)" for name in PRIORITIES}
    counted = pairs.groupBy("prospect_id").agg(*_named(officers))
    counted = counted.join(author_summary(pairs, tallies), "prospect_id", "left")
    counted = counted.join(capacity_summary(t), "prospect_id", "left")
    counted = counted.fillna(0, [c for c in counted.columns if c != "prospect_id"])  # the key stays what it is partitioned by
    gave = prospect_giving(t, p).select("prospect_id", (F.col("given") != 0).alias("gave"))
    return counted.join(gave, "prospect_id", "left").join(prospect_proposals(t, p, entries), "prospect_id", "left")


def _author_rows(officers: str, filed: str) -> str:
    """Rows of one author join: officers who filed, one shared row for those who did not, one if nobody qualifies."""
    return f"greatest({filed} + if({officers} > {filed}, 1, 0), 1)"


def fan_out_measures(
    cohort: DataFrame, tallies: DataFrame, entries: DataFrame, t: Tables, p: ReportParams, own_rows_only: bool
) -> DataFrame:
    """Counts and sums per officer over the joined rows of its cohort, from ``activity_tallies`` and ``newest_entries``.

    ``own_rows_only`` is the team-member form: the main contact join then matches the author too, so every cohort row
    meets its own officer's row or none. A missing row has null counts, which pass a "not zero" test.
    """
    pairs = shared(cohort_pairs(cohort))
    prospects = prospect_summary(pairs, tallies, t, p, entries)
    if own_rows_only:
        rows = by_cohort_officer(pairs, tallies).join(prospects, "prospect_id")
    else:
        rows = pairs.join(prospects, "prospect_id")

    factors = {
        "own": "1" if own_rows_only else _author_rows("officers", "filed"),
        "pq": _author_rows("pq_officers", "pq_filed"),
        "pm": _author_rows("pm_officers", "pm_filed"),
        "pool": "greatest(pool_rows, 1)",
    }
    # joined: joined rows of a cohort row; joined_but_x: the same with join x left out.
    weights = {"joined": " * ".join(["rows", *factors.values()])}
    for name in factors:
        weights[f"joined_but_{name}"] = " * ".join(["rows", *[f for n, f in factors.items() if n != name]])
    rows = rows.select("*", *_named(weights))

    def tests_met(met: str, join: str) -> str:
        return f"sum({met} * joined_but_{join})"

    def flagged(test: str, weight: str = "joined") -> str:
        return f"sum(if({test}, {weight}, 0))"

    measures = {}
    for name, test in OWN_TESTS.items():
        measures[name] = flagged(_own_test(*test), "joined_but_own") if own_rows_only else tests_met(name, "own")
    # Officers without any report have no row to test for zero in the team-member form.
    measures["unfiled"] = flagged("reports IS NULL", "joined_but_own") if own_rows_only else "0L"
    measures |= {name: flagged(name) for name in ANY_TESTS}
    measures |= {name: tests_met(name, "pool") for name in CAPACITY_TESTS}
    measures["gave"] = flagged("gave")
    for name, column in PROPOSAL_SUMS.items():
        times = "" if name == "proposals_dropped_before_ask" else " * prospect_rows"
        measures[name] = f"sum({column}{times} * joined)"
    for name in PRIORITIES:
        measures[f"{name}_visited"] = tests_met(f"{name}_visited", name)
        measures[f"{name}_qualified"] = tests_met(f"{name}_qualified", name)
    return rows.groupBy("officer_id").agg(*_named(measures))


class Sources(NamedTuple):
    """What the scorecards of both roles read of the large tables, stored."""

    tables: Tables
    window: DataFrame
    entries: DataFrame


def scorecard_sources(t: Tables, p: ReportParams) -> Sources:
    """``t`` with the active manager and team assignments alone, ``window_activity`` and ``newest_entries``."""
    columns = ["prospect_id", "assignment_id_number", "assignment_type", "active_ind", "priority_code", "start_date", "proposal_id"]
    held = shared(t.assignment.where(is_.is_assignment("S", "LM")).select(*columns))
    codes = tuple(dict.fromkeys(AGED_STAGES + AGED_PROPOSAL_STAGES + HISTORY_CODES))
    tables = Tables(lambda name: held if name == "assignment" else getattr(t, name))
    return Sources(tables, shared(window_activity(t, p)), shared(newest_entries(t, codes)))


def scorecards(t: Tables, p: ReportParams, *columns: str) -> DataFrame:
    """``role``, ``officer_id`` and the ``columns`` of the scorecards of both roles, which read the same stored sources."""
    sources = scorecard_sources(t, p)
    cards = [officer_scorecard(t, p, role, sources).select(F.lit(role).alias("role"), "officer_id", *columns) for role in ("LM", "S")]
    return cards[0].unionByName(cards[1])


def officer_scorecard(t: Tables, p: ReportParams, atype: str = "LM", sources: Sources | None = None) -> DataFrame:
    """The scorecard of managers ("LM") or team members ("S"), ordered by officer name.

    ``portfolio_size`` is always the size as manager and ``team_member_size`` the size as team member; shares divide by
    the size in the role the scorecard is for. ``sources`` (``scorecard_sources``) saves a second scorecard the large tables.
    """
    team = atype == "S"
    t, window, entries = sources or scorecard_sources(t, p)
    cohort = shared(prospect_cohort(t, atype))
    other_role = role_size(t, "LM" if team else "S").withColumnRenamed("role_size", "other_size")
    counted = reduce(
        lambda left, right: left.join(right, "officer_id", "left"),
        [
            outside_entities(cohort, t, p, anti=not team, window=window),
            age_counts(cohort, t, p, entries),
        ],
        officer_portfolio(cohort, t, p).withColumnRenamed("portfolio_size", "own_size"),
    ).fillna(0, ["entities", "n_q_1y", "n_cu_1y", "n_so_1y", "n_rb_1y", "n_am_1y"])
    measures = fan_out_measures(cohort, activity_of(window), entries, t, p, own_rows_only=team)
    card = counted.join(measures, "officer_id", "left")
    card = card.join(other_role, "officer_id", "left")

    def with_share(*names: str) -> dict[str, str]:
        return {k: v for name in names for k, v in ((name, name), (f"pct_{name}", f"{name} / own_size"))}

    stage_mix = {}
    for name, (count, aged) in STAGE_MIX.items():
        stage_mix |= {name: count, f"pct_{name}": f"{count} / own_size"}
        if aged:
            stage_mix[f"pct_{name}_1yr"] = f"{count}_1y / own_size"

    # An officer without proposals has null sums and null shares.
    proposals = {"proposals": "proposals"}
    for name in list(PROPOSAL_SUMS)[1:]:
        proposals |= {name: name, f"pct_{name}": f"{name} / proposals"}
    proposals |= {"pct_at_ask_planned_1yr": "n_rb_1y / proposals", "pct_at_ask_made_1yr": "n_am_1y / proposals"}

    def flag(test: str) -> Column:
        return scalars.yes_no(F.expr(test))

    def quartile(ratio: str) -> Column:
        return scalars.quartile_label(F.expr(ratio))

    by_priority = {}
    for name in PRIORITIES:
        by_priority[f"{name}_size"] = f"{name}_size"
        for kind in ("visited", "qualified"):
            count = f"if({name}_size = 0, NULL, {name}_{kind})"
            by_priority |= {f"{name}_{kind}": count, f"pct_{name}_{kind}": f"{count} / nullif({name}_size, 0)"}

    return card.select(
        "officer_name",
        "officer_id",
        "office",
        "unit",
        "officer_type",
        "years_as_officer",
        F.col("other_size" if team else "own_size").alias("portfolio_size"),
        F.col("own_size" if team else "other_size").alias("team_member_size"),
        *_named({"total_qualified": "n_st + n_cu + n_so", "total_to_be_qualified": "n_q"}),
        *_named(
            with_share(
                "ask_major_by_officer",
                "ask_major_any",
                "ask_any_by_officer",
                "ask_special_by_officer",
                "ask_any_any",
                "ask_special_any",
                "contacted_by_officer",
                "visited_by_officer",
                "visited_twice_by_officer",
                "contacted_any",
                "visited_any",
            )
        ),
        F.col("entities").alias("outside_entities"),
        *_named(with_share(*CAPACITY_TESTS, "gave")),
        *_named(stage_mix),
        *_named(with_share("documented_strategy")),
        "dq_nn_nr_reports",
        "qualified_reports",
        *_named(proposals),
        F.col("years_as_officer").cast("bigint").alias("years_floor"),
        scalars.size_recommended(F.col("officer_type"), F.col("own_size"), p).alias("size_recommended"),
        flag("rated_ge_100k / own_size > 0.5D").alias("rated_100k_over_half"),
        flag("rated_lt_50k / own_size > 0.25D").alias("rated_lt_50k_over_quarter"),
        flag("n_q / own_size > 0.25D").alias("qualification_over_quarter"),
        flag("(n_cu + n_st) / own_size >= 0.5D").alias("cultivation_stewardship_half"),
        flag("n_so / own_size >= 0.1D").alias("solicitation_tenth"),
        quartile("(contacted_by_officer + unfiled) / own_size").alias("contact_quartile"),
        quartile("(visited_by_officer + unfiled) / own_size").alias("visit_quartile"),
        quartile("ask_major_any / own_size").alias("ask_major_any_quartile"),
        quartile("(ask_special_by_officer + unfiled) / own_size").alias("ask_special_quartile"),
        quartile("proposals_ask_made / proposals").alias("ask_made_quartile"),
        quartile("proposals_closed / proposals").alias("closed_quartile"),
        *_named(by_priority),
        now(p).alias("date_pulled"),
        F.lit(window_label(p.window)).alias("date_range"),
    ).orderBy(F.col("officer_name").asc_nulls_last())
