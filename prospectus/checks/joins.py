"""Join forms, each on the tables the reports use it for."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectus.checks import sqltext as s
from prospectus.checks.aggregates import ALL_BY_AUTHOR, FIRST_ASK, VISITS_TO_ASK
from prospectus.checks.registry import check
from prospectus.functions import predicates as is_
from prospectus.operators import contacts, officers, proposals, stages
from prospectus.operators.cohorts import cohort_pairs, om_cohort, prospect_cohort
from prospectus.operators.fan_out import fan_out_join
from prospectus.operators.giving import primary_pool
from prospectus.plans import flows
from prospectus.plans.analysis import pool_sheet


@check(
    "jn_left_dim",
    """SELECT st.id_number, st.sort, ofc.short_desc AS office, un.full_desc AS unit, bio.sort_name
    FROM staff st LEFT JOIN tms_office ofc ON ofc.office_code = st.office_code
    LEFT JOIN tms_unit_code un ON un.unit_code = st.unit_code
    LEFT JOIN ucdr_bio bio ON bio.id_number = st.id_number""",
)
def _(t, p):
    return (
        t.staff.join(t.tms_office.withColumnRenamed("short_desc", "office"), "office_code", "left")
        .join(t.tms_unit_code.withColumnRenamed("full_desc", "unit"), "unit_code", "left")
        .join(t.ucdr_bio, "id_number", "left")
        .select("id_number", "sort", "office", "unit", "sort_name")
    )


@check(
    "jn_left_on_filter",
    """SELECT pr.prospect_id, asg.assignment_id_number, asg.priority_code FROM prospect pr
    LEFT JOIN assignment asg ON asg.prospect_id = pr.prospect_id AND asg.active_ind = 'Y'
    AND asg.assignment_type = 'LM'""",
)
def _(t, p):
    held = t.assignment.where(is_.is_assignment("LM")).select("prospect_id", "assignment_id_number", "priority_code")
    return t.prospect.select("prospect_id").join(held, "prospect_id", "left")


@check(
    "jn_inner_staff",
    """SELECT asg.prospect_id, st.id_number, st.sort, st.unit_code FROM assignment asg, staff st
    WHERE asg.assignment_id_number = st.id_number AND asg.active_ind = 'Y' AND asg.assignment_type = 'S'""",
)
def _(t, p):
    held = t.assignment.where(is_.is_assignment("S")).withColumnRenamed("assignment_id_number", "id_number")
    staff = t.staff.select("id_number", "sort", "unit_code")
    return held.select("prospect_id", "id_number").join(staff, "id_number")


@check(
    "jn_left_made_inner",
    """SELECT pr.prospect_id, asg.assignment_id_number, st.sort FROM prospect pr
    LEFT JOIN assignment asg ON asg.prospect_id = pr.prospect_id AND asg.assignment_type = 'LM'
    LEFT JOIN staff st ON st.id_number = asg.assignment_id_number
    WHERE asg.active_ind = 'Y' AND st.staff_type_code = 'DEV'""",
)
def _(t, p):
    officers_ = t.staff.where(is_.is_development_staff())
    return (
        t.prospect.select("prospect_id")
        .join(t.assignment.where(is_.is_assignment("LM")).select("prospect_id", "assignment_id_number"), "prospect_id")
        .join(officers_.select(F.col("id_number").alias("assignment_id_number"), "sort"), "assignment_id_number")
    )


@check(
    "jn_composite_key",
    """SELECT pl.proposal_id, pl.prospect_id, pl.stage_code, count(sg.stage_date) AS entries,
    min(sg.stage_date) AS first_entry FROM proposal pl LEFT JOIN stage sg ON sg.prospect_id = pl.prospect_id
    AND sg.stage_code = pl.stage_code AND sg.proposal_id = pl.proposal_id
    WHERE pl.proposal_type LIKE 'MG%' GROUP BY ALL""",
)
def _(t, p):
    keys = ["prospect_id", "stage_code", "proposal_id"]
    entered = t.stage.groupBy(*keys).agg(F.count("stage_date").alias("entries"), F.min("stage_date").alias("first_entry"))
    return (
        t.proposal.where(is_.is_major_gift())
        .select(*keys)
        .join(entered, keys, "left")
        .withColumn("entries", F.coalesce("entries", F.lit(0)))
    )


@check(
    "jn_range_one_sided",
    s.with_cohort(FIRST_ASK, s.OM),
)
def _(t, p):
    return contacts.first_ask(om_cohort(t, p), t).drop("visits")


@check("jn_range_two_sided", s.with_cohort(VISITS_TO_ASK, s.OM))
def _(t, p):
    return contacts.visits_to_ask(contacts.first_ask(om_cohort(t, p), t))


@check("jn_anti_left_null", s.with_cohort(s.entity_visits(True)))
def _(t, p):
    cohort = prospect_cohort(t)
    return contacts.not_held(contacts.officer_entity_visits(cohort, t, p), t)


@check(
    "jn_semi_in",
    f"""SELECT prospect_id FROM prospect WHERE {s.within('stop_date')} AND prospect_id IN
    (SELECT r.prospect_id FROM contact_report r WHERE r.contact_outcome IN ('NN', 'DQ'))""",
)
def _(t, p):
    return flows.dropped_after_outcome(t, p)


@check(
    "jn_anti_not_in",
    f"""SELECT proposal_id, prospect_id FROM proposal WHERE starts_with(proposal_type, 'MG')
    AND {s.within('start_date')} AND proposal_id NOT IN (SELECT pl.proposal_id FROM proposal pl
      JOIN stage h ON h.proposal_id = pl.proposal_id WHERE h.stage_code IN ('AM', 'GC', 'DN', 'ST')
      AND {s.within('pl.date_added')})""",
)
def _(t, p):
    asked = proposals.proposal_history(t).where("asked").select("proposal_id")
    added = t.proposal.where(is_.in_window("date_added", p.window)).select("proposal_id")
    return (
        t.proposal.where(is_.is_major_gift() & is_.in_window("start_date", p.window))
        .join(asked.join(added, "proposal_id", "left_semi"), "proposal_id", "left_anti")
        .select("proposal_id", "prospect_id")
    )


@check(
    "jn_rank1",
    """SELECT pool.prosp_id AS prospect_id, pool.id_number, g.date_of_record AS last_gift_date,
    f.date_of_record AS af_last_date, f.prim_amt AS af_last_amt FROM ucdr_prospect_pool pool
    LEFT JOIN (SELECT id_number, date_of_record,
        row_number() OVER (PARTITION BY id_number ORDER BY date_of_record DESC NULLS FIRST) AS place
        FROM ucdr_giving WHERE giving_ind IN ('P', 'G')) g ON g.id_number = pool.id_number AND g.place = 1
    LEFT JOIN (SELECT id_number, date_of_record, prim_amt, row_number() OVER (PARTITION BY id_number
        ORDER BY date_of_record DESC NULLS FIRST, prim_amt DESC NULLS FIRST) AS place
        FROM ucdr_giving WHERE giving_ind IN ('P', 'G') AND prog_hier_num = '1') f
      ON f.id_number = pool.id_number AND f.place = 1
    WHERE pool.prim_prosp_ind = 'Y'""",
)
def _(t, p):
    return pool_sheet(t).select("prospect_id", "id_number", "last_gift_date", "af_last_date", "af_last_amt")


@check(
    "jn_fan_out",
    s.with_cohort(
        f"""SELECT c.prospect_id, c.officer_id, c.priority_code, a.author_id, a.contacts, a.visits, a.latest_visit
        FROM cohort c LEFT JOIN ({ALL_BY_AUTHOR}) a ON a.prospect_id = c.prospect_id""",
        s.MANAGED,
    ),
)
def _(t, p):
    cohort = prospect_cohort(t, named=False, require_active_staff=False, start="assigned")
    rows = cohort.select("prospect_id", "officer_id", "priority_code")
    authors = contacts.contacts_by_officer(
        contacts.by_cohort_officer(cohort_pairs(cohort), contacts.coverage_tallies(t, p))
    )
    return fan_out_join(rows, authors, key="prospect_id", sized_by=(rows, rows))


@check(
    "jn_officer_rollback",
    s.with_cohort(
        f"""SELECT c.prospect_id, c.officer_id, c.priority_code, q.portfolio_size, q.pq_size, q.n_q
        FROM cohort c LEFT JOIN ({s.officer_portfolio()}) q ON q.officer_id = c.officer_id"""
    ),
)
def _(t, p):
    cohort = prospect_cohort(t)
    sizes = officers.officer_counts(cohort).select("officer_id", "portfolio_size", "pq_size", "n_q")
    return cohort.select("prospect_id", "officer_id", "priority_code").join(sizes, "officer_id", "left")


@check(
    "jn_redundant_distinct",
    f"""SELECT DISTINCT pr.prospect_id, pr.start_date FROM prospect pr
    LEFT JOIN assignment asg ON asg.prospect_id = pr.prospect_id AND asg.assignment_type = 'LM'
    WHERE {s.within('pr.start_date')}""",
)
def _(t, p):
    return t.prospect.where(is_.in_window("start_date", p.window)).select("prospect_id", "start_date").distinct()


@check("jn_self_next", f"SELECT DISTINCT proposal_id, stage_date, next_date FROM ({s.STAGE_SPANS})")
def _(t, p):
    return stages.proposal_stage_intervals(t).select("proposal_id", "stage_date", "next_date").distinct()


@check(
    "jn_bridge",
    """SELECT pe.prospect_id, pool.id_number, pool.sort_name, 'bridge' AS route FROM prospect_entity pe
    JOIN ucdr_prospect_pool pool ON pool.id_number = pe.id_number WHERE pe.primary_ind = 'Y'
    UNION ALL SELECT pr.prospect_id, pool.id_number, pool.sort_name, 'pool' FROM prospect pr
    JOIN ucdr_prospect_pool pool ON pool.prosp_id = pr.prospect_id WHERE pool.prim_prosp_ind = 'Y'""",
)
def _(t, p):
    bridge = t.prospect_entity.where(is_.is_primary("primary_ind")).select("prospect_id", "id_number")
    pool = t.ucdr_prospect_pool.select("id_number", "sort_name")
    through_bridge = bridge.join(pool, "id_number").withColumn("route", F.lit("bridge"))
    through_pool = (
        t.prospect.select("prospect_id")
        .join(primary_pool(t).select("prospect_id", "id_number", "sort_name"), "prospect_id")
        .withColumn("route", F.lit("pool"))
    )
    return through_bridge.unionByName(through_pool).select("prospect_id", "id_number", "sort_name", "route")


@check(
    "jn_prospect_rollback",
    s.with_cohort(
        f"""SELECT c.prospect_id, c.officer_id, c.priority_code, a.contacts, a.visits, a.ask
        FROM cohort c LEFT JOIN ({s.any_activity(s.ANY_TESTS)}) a ON a.prospect_id = c.prospect_id"""
    ),
)
def _(t, p):
    cohort = prospect_cohort(t)
    anyone = contacts.any_officer_activity(cohort, t, p).select("prospect_id", "contacts", "visits", "ask")
    return cohort.select("prospect_id", "officer_id", "priority_code").join(anyone, "prospect_id", "left")
