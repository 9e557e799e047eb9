"""Hand-made rows for behaviours of the published reports that are easy to lose."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from prospectus import plans
from prospectus.functions import dates, scalars
from prospectus.operators import contacts, giving, officers, proposals, stages
from prospectus.operators.cohorts import cohort_pairs, om_cohort, proposal_cohort, prospect_cohort
from prospectus.params import ReportParams
from prospectus.plans.scorecard import officer_scorecard

P = ReportParams(as_of=datetime(2017, 8, 1))
DAY = datetime(2016, 1, 5)


def prospect(i, **more):
    return {"prospect_id": i, "active_ind": "Y", "stage_code": "Q", **more}


def officer(i, **more):
    return {"id_number": i, "sort": f"Officer {i}", "staff_type_code": "DEV", "active_ind": "Y", "unit_code": "MG",
            "start_date": datetime(2010, 1, 1), **more}


def holds(i, who, kind="LM", **more):
    return {"prospect_id": i, "assignment_id_number": who, "assignment_type": kind, "active_ind": "Y",
            "priority_code": "PQ", "start_date": datetime(2014, 1, 1), **more}


def report(i, who, kind="V", at=DAY, **more):
    return {"report_id": 1, "prospect_id": i, "id_number": f"{i:010d}", "author_id_number": who, "contact_type": kind,
            "contact_initiated_by": "DO", "contact_purpose_code": "C", "contact_outcome": " ", "contact_date": at, **more}


UNITS = [{"unit_code": "MG", "short_desc": "Major Gifts", "full_desc": "Major Gifts"}]


def by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def two_officers(tables, kind, priority=None):
    held = [holds(1, who, kind, priority_code=priority) for who in "AB"]
    return tables(prospect=[prospect(1)], staff=[officer("A"), officer("B")], tms_unit_code=UNITS, assignment=held,
                  contact_report=[report(1, "A")])


def test_prospect_with_two_managers_counts_for_both(tables):
    # Each of the two cohort rows meets A's row and the shared empty row.
    card = officer_scorecard(two_officers(tables, "LM"), P)
    assert by(card, "officer_id", "visited_by_officer", "portfolio_size") == {"A": (1, 1), "B": (1, 1)}


def test_team_members_count_their_own_visits(tables):
    card = officer_scorecard(two_officers(tables, "S"), P, "S")
    assert by(card, "officer_id", "visited_by_officer", "team_member_size") == {"A": (1, 1), "B": (0, 1)}


def test_priority_rows_multiply_the_main_rows(tables):
    # A's row and the empty row of the main join, each met by A's and the empty PQ row.
    card = officer_scorecard(two_officers(tables, "LM", "PQ"), P)
    assert by(card, "officer_id", "visited_by_officer", "pq_visited") == {"A": (2, 2), "B": (2, 2)}


def test_team_priority_counts_still_fan_out(tables):
    card = officer_scorecard(two_officers(tables, "S", "PQ"), P, "S")
    # One PQ row of A and one empty row: both officers see A's visit.
    assert by(card, "officer_id", "pq_visited") == {"A": 1, "B": 1}


def test_missing_reports_in_the_quartile(tables):
    t = tables(prospect=[prospect(i) for i in range(4)], staff=[officer("C")], tms_unit_code=UNITS,
               assignment=[holds(i, "C") for i in range(4)])
    card = officer_scorecard(t, P).first()
    assert (card.contact_quartile, card.pct_contacted_by_officer) == ("<25%", 0.0)


def test_missing_reports_in_the_team_quartile(tables):
    t = tables(prospect=[prospect(i) for i in range(4)], staff=[officer("C")], tms_unit_code=UNITS,
               assignment=[holds(i, "C", "S") for i in range(4)])
    card = officer_scorecard(t, P, "S").first()
    assert (card.contact_quartile, card.pct_contacted_by_officer) == ("75%+", 0.0)


def test_officer_without_proposals(tables):
    t = tables(prospect=[prospect(1)], staff=[officer("D")], assignment=[holds(1, "D")], tms_unit_code=UNITS)
    card = officer_scorecard(t, P).first()
    assert (card.proposals, card.pct_proposals_closed, card.pct_at_ask_made_1yr) == (None, None, None)
    assert (card.ask_made_quartile, card.closed_quartile) == ("75%+", "75%+")
    assert (card.pm_size, card.pm_visited, card.pct_pm_visited) == (0, None, None)
    assert card.team_member_size is None


def test_outcomes(tables):
    outcomes = [None, " ", "DU", "QU"]
    t = tables(
        prospect=[prospect(i) for i in range(4)], staff=[officer("A")], assignment=[holds(i, "A") for i in range(4)],
        contact_report=[report(i, "A", contact_outcome=o) for i, o in enumerate(outcomes)],
    )
    assert by(contacts.last_qualification(t), "prospect_id", "contact_outcome") == {3: "QU"}
    activity = contacts.officer_activity(prospect_cohort(t), t, P, "PQ")
    assert by(activity, "prospect_id", "qualified") == {0: 0, 1: 0, 2: 1, 3: 1}


def test_unfavourable_outcomes_do_not_include_dq(tables):
    t = tables(prospect=[prospect(1)], staff=[officer("A")], assignment=[holds(1, "A")],
               contact_report=[report(1, "A", contact_outcome=o) for o in ("DQ", "DD", "NN", "NR")])
    assert contacts.officer_activity(prospect_cohort(t), t, P).first().dq_nn_nr == 3


def test_call_initiated_by_the_central_office_is_a_visit(tables):
    t = tables(prospect=[prospect(1)], staff=[officer("A")], assignment=[holds(1, "A")],
               contact_report=[report(1, "A", "C", contact_initiated_by="FCGS"), report(1, "A", "C")])
    activity = contacts.officer_activity(prospect_cohort(t), t, P).first()
    assert (activity.contacts, activity.visits) == (2, 1)


def test_window_ends_at_midnight(tables):
    t = tables(prospect=[prospect(1)], staff=[officer("A")], assignment=[holds(1, "A")],
               contact_report=[report(1, "A", at=datetime(2017, 6, 30)), report(1, "A", at=datetime(2017, 6, 30, 10))])
    assert contacts.officer_activity(prospect_cohort(t), t, P).first().contacts == 1


@pytest.mark.parametrize(
    "at, months, expected",
    [
        (datetime(2015, 2, 28), -13, datetime(2014, 1, 31)),
        (datetime(2015, 3, 30, 7, 5), -13, datetime(2014, 2, 28, 7, 5)),
        (datetime(2015, 3, 15, 7, 5), -13, datetime(2014, 2, 15, 7, 5)),
        (datetime(2016, 2, 29, 1), 1, datetime(2016, 3, 31, 1)),
    ],
)
def test_add_months(spark, at, months, expected):
    assert spark.range(1).select(dates.add_months(dates.ts(at), months)).first()[0] == expected


def test_rolling_window_is_thirteen_months_and_one_report_starts_a_day_earlier(tables):
    at = [datetime(2016, 6, 30, 23), datetime(2016, 7, 1), datetime(2016, 6, 30)]
    t = tables(prospect=[prospect(1)], staff=[officer("A")], assignment=[holds(1, "A")],
               contact_report=[report(1, "A", at=a) for a in at])
    cohort = prospect_cohort(t)
    for days_earlier, expected in ((0, 1), (1, 3)):
        held = contacts.by_cohort_officer(cohort_pairs(cohort), contacts.coverage_tallies(t, P, days_earlier))
        assert contacts.recent_contacts_by_officer(held).first().recent_contacts == expected


def entered(code, *ymd):
    return {"proposal_id": 1, "prospect_id": 1, "stage_code": code, "stage_date": datetime(*ymd)}


def test_equal_stage_dates_share_the_next_date(tables):
    t = tables(stage=[entered("RB", 2015, 1, 1), entered("AM", 2015, 3, 1), entered("GC", 2015, 3, 1),
                      entered("ST", 2015, 6, 1)])
    row = stages.stage_days(t, replace(P, as_of=datetime(2015, 6, 11))).first()
    assert (row.days_rb, row.days_am, row.days_gc, row.days_st, row.days_dp) == (59, 92, 92, 10, None)


def test_stage_entered_twice(tables):
    t = tables(stage=[entered("RB", 2015, 1, 1), entered("AM", 2015, 2, 1), entered("RB", 2015, 3, 1),
                      entered("AM", 2015, 4, 1)])
    row = stages.stage_days(t, replace(P, as_of=datetime(2015, 4, 6))).first()
    assert (row.days_rb, row.days_am) == (62, 33)


def test_undated_gift_ranks_first(tables):
    gifts = [{"id_number": "1", "giving_ind": "G", "prog_hier_num": "1", "date_of_record": d, "prim_amt": Decimal(a)}
             for d, a in ((None, 5), (datetime(2000, 1, 1), 7))]
    t = tables(ucdr_giving=gifts)
    assert giving.last_gift(t).first().last_gift_date is None
    row = giving.last_annual_fund_gift(t).first()
    assert (row.af_last_date, row.af_last_amt) == (None, Decimal("5.00"))


def test_scorecard_giving_counts_every_kind_and_the_sheet_only_gifts_and_pledges(tables):
    pool = [{"prosp_id": 1, "id_number": "1", "prim_prosp_ind": "Y"}]
    gifts = [{"id_number": "1", "giving_ind": "M", "date_of_record": DAY, "prim_amt": Decimal(10)}]
    t = tables(prospect=[prospect(1)], staff=[officer("A")], assignment=[holds(1, "A")], ucdr_prospect_pool=pool,
               ucdr_giving=gifts)
    assert officer_scorecard(t, P).first().gave == 1
    assert plans.portfolio_analysis(t, P).first().last_gift_date is None


@pytest.mark.parametrize("ask, granted, expected", [(None, 50, 0), (0, 50, 0), (100, 50, 0.5), (100, None, None)])
def test_safe_ratio(spark, ask, granted, expected):
    money = [F.lit(v).cast("decimal(18,2)") for v in (granted, ask)]
    assert spark.range(1).select(scalars.safe_ratio(*money)).first()[0] == expected


def sheet(tables, held_since, **pool):
    pool = {"prosp_id": 1, "id_number": "1", "prim_prosp_ind": "Y", "pers_org_ind": "P", **pool}
    t = tables(prospect=[prospect(1)], staff=[officer("A", active_ind="N")], ucdr_prospect_pool=[pool],
               assignment=[holds(1, "A", start_date=None, date_added=held_since)])
    row = plans.portfolio_analysis(t, P).first()
    return row.assessment


def test_assessment_tries_rules_in_order(tables):
    poor = {"abs_high_capacity_ucdt_asks": Decimal(10000), "lifetime_giving_devel": Decimal(0)}
    assert sheet(tables, datetime(2017, 3, 10), **poor) == "ORANGE"


def test_assessment_of_a_poor_prospect(tables):
    poor = {"abs_high_capacity_ucdt_asks": Decimal(10000), "lifetime_giving_devel": Decimal(0)}
    assert sheet(tables, datetime(2015, 3, 10), **poor) == "RED"


def test_unknown_giving_moves_on_to_the_next_rule(tables):
    assert sheet(tables, datetime(2015, 3, 10), abs_high_capacity_ucdt_asks=Decimal(10000)) == "RED"


def test_unknown_capacity_falls_through(tables):
    assert sheet(tables, datetime(2015, 3, 10)) == "YELLOW2"


def test_organisations_are_not_assessed(tables):
    assert sheet(tables, datetime(2015, 3, 10), pers_org_ind="O") is None


@pytest.mark.parametrize(
    "stop, label",
    [(None, "FY 17-18"), (datetime(2017, 8, 1), "FY 16-17"), (datetime(2016, 8, 1), "FY 16-17"),
     (datetime(2015, 8, 1), "FY 15-16"), (datetime(2018, 8, 1), None)],
)
def test_fiscal_year_labels(spark, stop, label):
    column = F.lit(None).cast("timestamp_ntz") if stop is None else dates.ts(stop)
    assert spark.range(1).select(column.alias("d")).select(scalars.fiscal_year("d", P)).first()[0] == label


def test_added_dropped_counts(tables):
    starts = [datetime(2015, 7, 1), datetime(2016, 6, 30), datetime(2016, 6, 30, 9), datetime(2017, 6, 30),
              datetime(2017, 6, 30, 1), None]
    t = tables(prospect=[prospect(i, start_date=d, stop_date=d) for i, d in enumerate(starts)],
               contact_report=[report(3, "A", contact_outcome="DQ"), report(3, "B", contact_outcome="NN"),
                               report(4, "A", contact_outcome="NN"), report(0, "A", contact_outcome="DD")])
    assert tuple(plans.prospects_added(t, P).first()) == (4, 2, 1)
    assert tuple(plans.prospects_dropped(t, P).first()) == (4, 2, 1)
    assert plans.dropped_nn_dq(t, P).first()[0] == 1


def test_outside_visits_skip_held_entities_for_managers_only(tables):
    t = tables(prospect=[prospect(1)], staff=[officer("A")], assignment=[holds(1, "A"), holds(1, "A", "S")],
               prospect_entity=[{"prospect_id": 1, "id_number": f"{1:010d}", "primary_ind": "N"}],
               contact_report=[report(1, "A"), report(2, "A"), report(2, "A")])
    assert officer_scorecard(t, P).first().outside_entities == 1
    assert officer_scorecard(t, P, "S").first().outside_entities == 2


def test_ask_before_the_assignment_is_no_ask(tables):
    t = tables(prospect=[prospect(1)], staff=[officer("A")], assignment=[holds(1, "A", start_date=DAY)],
               contact_report=[report(1, "A", at=datetime(2016, 1, 4), contact_purpose_code="A")])
    row = contacts.first_ask(om_cohort(t, P), t).first()
    assert (row.ask_date, row.visits) == (None, 0)


def test_visits_to_ask_add_up_over_officers(tables):
    ask = {"contact_purpose_code": "A"}
    t = tables(prospect=[prospect(1)], staff=[officer("A"), officer("B")],
               assignment=[holds(1, "A", start_date=DAY), holds(1, "B", start_date=DAY)],
               contact_report=[report(1, "A", at=DAY, **ask), report(1, "A", "C", at=DAY, **ask), report(1, "A", at=DAY),
                               report(1, "B", at=datetime(2016, 3, 1), **ask),
                               report(1, "B", at=datetime(2016, 4, 1), **ask)])
    rows = plans.om_prospects(t, P).collect()
    assert {r.visits_to_ask for r in rows} == {2}
    assert sorted((r.rm_name, r.ask_date) for r in rows) == [
        (f"Officer {o}", d) for o in "AB" for d in (DAY, datetime(2016, 3, 1))]


def test_dropped_before_ask(tables):
    histories = {1: ("RB", "DP"), 2: ("RB", "AM", "DP"), 3: ("RB", "PL", "DP"), 4: ("RB",)}
    t = tables(
        proposal=[{"proposal_id": i, "prospect_id": 1, "proposal_type": "MGL", "stage_code": "PL", "start_date": DAY,
                   "date_added": DAY} for i in histories],
        stage=[{"proposal_id": i, "prospect_id": 1, "stage_code": c} for i, cs in histories.items() for c in cs],
    )
    dropped = proposals.windowed_proposals(t, P).where("dropped")
    assert sorted(r.proposal_id for r in dropped.collect()) == [1, 3]
    assert proposals.prospect_proposals(t, P).first().ask_made == 4


def test_cohort_duplicates_inflate_counts(tables):
    t = tables(prospect=[prospect(1)], staff=[officer("A")],
               assignment=[holds(1, "A"), holds(1, "A", priority_code="PM")], contact_report=[report(1, "A")])
    cohort = prospect_cohort(t)
    assert contacts.officer_activity(cohort, t, P).first().visits == 2
    assert officer_scorecard(t, P).first().visited_twice_by_officer == 2


def test_inactive_officers_stay_in_the_coverage_report_only(tables):
    t = tables(prospect=[prospect(1)], staff=[officer("A", active_ind="N")], assignment=[holds(1, "A"), holds(1, "A")])
    row = plans.portfolio_percents(t, P).first()
    # The cohort is distinct, the size is not.
    assert (row.portfolio_size, officer_scorecard(t, P).count()) == (2, 0)


def test_time_at_stage_credits_one_officer(tables):
    t = tables(prospect=[prospect(1)], staff=[officer("A"), officer("B")], assignment=[holds(1, "B"), holds(1, "A")],
               stage=[{"prospect_id": 1, "stage_code": "Q", "stage_date": datetime(2015, 1, 1), "date_added": DAY}])
    assert by(officers.stage_age_counts(prospect_cohort(t), t, P), "officer_id", "n_q_1y") == {"A": 1}


def test_thresholds_and_sizes(spark):
    kinds = {"Planned Giving Officer": (75, 74), "Annual Special": (200, 199)}
    for kind, (enough, short) in kinds.items():
        flags = [scalars.size_recommended(F.lit(kind), F.lit(n), P) for n in (enough, short)]
        assert tuple(spark.range(1).select(*flags).first()) == ("Yes", "No")
    others = [scalars.size_recommended(F.lit(k), F.lit(10**6), P) for k in ("Major Gift Officer", "Leadership")]
    assert tuple(spark.range(1).select(*others).first()) == ("No", "N/A")


def test_visits_by_author(tables):
    t = tables(prospect=[prospect(i) for i in (1, 2)], staff=[officer("A"), officer("B")],
               assignment=[holds(1, "A"), holds(1, "B", priority_code="PM")],
               ucdr_bio=[{"id_number": "A", "sort_name": "Ann"}],
               contact_report=[report(1, "A"), report(1, "A", "X"), report(2, "A"), report(1, "C")])
    rows = by(plans.om_visits(t, P), "author_id", "author_name", "visits_by_rm", "visits_by_non_rm", "no_rm", "visits_pq")
    assert rows == {"A": ("Ann", 1, 1, 1, 1), "C": (None, 0, 2, 0, 1)}


def test_proposal_reaches_its_prospect_through_the_bridge(tables):
    t = tables(
        proposal=[{"proposal_id": 1, "prospect_id": 1, "proposal_type": "MGL", "stage_code": "RB", "start_date": DAY}],
        prospect_entity=[{"prospect_id": 1, "id_number": "e", "primary_ind": "Y"}],
        ucdr_prospect_pool=[{"prosp_id": 7, "id_number": "e", "prim_prosp_ind": "N", "sort_name": "Name"}],
    )
    assert proposal_cohort(t, P).first().prospect_name == "Name"


def test_visits_count_once_for_each_row_of_a_name(tables):
    visit = {"report_id": 1, "prospect_id": 1, "author_id_number": "A", "contact_type": "V", "contact_date": datetime(2016, 5, 1)}
    names = [{"id_number": "A", "sort_name": "Equal"}] * 2 + [{"id_number": "A", "sort_name": "Other"}]
    t = tables(contact_report=[visit], ucdr_bio=names)
    rows = sorted((r.author_name, r.no_rm) for r in plans.om_visits(t, ReportParams(as_of=datetime(2017, 8, 1))).collect())
    assert rows == [("Equal", 2), ("Other", 1)]
