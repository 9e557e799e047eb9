"""Contact reports, counted per officer and prospect.

A contact report table is the largest input, and one prospect, author or pair may own much of it. Every function here
reduces reports to counts per (prospect, author) first, with map-side partial aggregation, and joins cohort rows to the
counts afterwards. No report row is ever joined to a cohort row.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectus.functions import predicates as is_
from prospectus.operators.cohorts import cohort_pairs, cohort_rows_per_prospect, held_entities
from prospectus.operators.ranking import latest_by, with_next_event
from prospectus.params import ReportParams
from prospectus.sources.tables import Tables

_PAIR = ["prospect_id", "author_id"]
COVERAGE = ["contacts", "visits"]
RECENT = ["recent_contacts", "recent_visits"]
ACTIVITY = ["contacts", "visits", "ask_or_special", "ask", "special", "strategy", "dq_nn_nr", "qu", "qualified"]


def _reports(t: Tables) -> DataFrame:
    """Reports of known prospects. An unknown author becomes "", so that the column is never null.

    With a non-null join key Spark adds no filter of its own to one of two uses of the same aggregate, and can
    compute it once for both.
    """
    author = F.coalesce("author_id_number", F.lit(""))
    return t.contact_report.where(F.col("prospect_id").isNotNull()).withColumn("author_id", author)


def coverage_tallies(t: Tables, p: ReportParams, days_earlier: int = 0) -> DataFrame:
    """Contacts and visits per (prospect, author): all time, and in the rolling window."""
    recent = is_.in_rolling("contact_date", p, days_earlier)
    return (
        _reports(t)
        .where(is_.is_contact())
        .groupBy(*_PAIR)
        .agg(
            F.count("*").alias("contacts"),
            F.count_if(is_.is_visit()).alias("visits"),
            F.max(F.when(is_.is_visit(), F.col("contact_date"))).alias("latest_visit"),
            F.count_if(recent).alias("recent_contacts"),
            F.count_if(recent & is_.is_visit()).alias("recent_visits"),
        )
    )


def _activity_counts() -> list[Column]:
    return [
        F.count("*").alias("reports"),
        F.count_if(is_.is_contact()).alias("contacts"),
        F.count_if(is_.is_visit()).alias("visits"),
        F.count_if(is_.is_ask_or_special()).alias("ask_or_special"),
        F.count_if(is_.is_ask()).alias("ask"),
        F.count_if(is_.is_special()).alias("special"),
        F.count_if(is_.is_strategy()).alias("strategy"),
        F.count_if(is_.outcome_in(*is_.UNFAVOURABLE)).alias("dq_nn_nr"),
        F.count_if(is_.outcome_in("QU")).alias("qu"),
        F.count_if(is_.has_outcome()).alias("qualified"),
    ]


def activity_tallies(t: Tables, p: ReportParams) -> DataFrame:
    """What each author did for each prospect in the report window."""
    return (
        _reports(t)
        .where(is_.in_window("contact_date", p.window))
        .groupBy(*_PAIR)
        .agg(*_activity_counts())
    )


def window_activity(t: Tables, p: ReportParams) -> DataFrame:
    """Reports in the window, counted once per (prospect, author, entity): the finest grain of ``activity_tallies`` and
    ``officer_entity_visits``, for reports that need both. Unknown prospects, authors and entities stay null."""
    return (
        t.contact_report.where(is_.in_window("contact_date", p.window))
        .groupBy("prospect_id", "author_id_number", F.col("id_number").alias("entity_id"))
        .agg(*_activity_counts(), F.count(F.when(is_.is_visit(), F.col("report_id"))).alias("visit_reports"))
    )


def activity_of(window: DataFrame) -> DataFrame:
    """``activity_tallies`` rolled up from ``window_activity``."""
    known = window.where(F.col("prospect_id").isNotNull())
    author = F.coalesce("author_id_number", F.lit("")).alias("author_id")
    return known.groupBy("prospect_id", author).agg(*[F.sum(c).alias(c) for c in ("reports", *ACTIVITY)])


def entity_visits_of(window: DataFrame) -> DataFrame:
    """Visits per (author, entity) rolled up from ``window_activity``."""
    return (
        window.where(F.col("visits") > 0)
        .groupBy(F.col("author_id_number").alias("officer_id"), "entity_id")
        .agg(F.sum("visit_reports").alias("visits"))
    )


def kept_whole(tallies: DataFrame) -> DataFrame:
    """Tallies behind an always-true condition that names every count and date.

    For reports that use one tally table in several joins, each reading other columns. Column pruning would give each
    use an aggregate, a shuffle and a scan of its own; with all columns kept the uses are equal, and Spark runs one.
    """
    counts = [c for c, kind in tallies.dtypes if kind == "bigint" and c not in _PAIR]
    dates = [c for c, kind in tallies.dtypes if kind.startswith("timestamp")]
    return tallies.where(reduce(or_, [F.col(d).isNotNull() for d in dates], F.greatest(*counts) >= 0))


def by_cohort_officer(pairs: DataFrame, tallies: DataFrame) -> DataFrame:
    """Cohort pairs with the tallies of their own officer; tallies are null where the officer filed nothing."""
    return pairs.join(tallies.withColumnRenamed("author_id", "officer_id"), ["prospect_id", "officer_id"], "left")


def per_author(
    held: DataFrame, counts: list[str], filed: Column, weight: str = "rows", dates: tuple[str, ...] = ()
) -> DataFrame:
    """Tallies per (prospect, author) times the cohort rows of the pair.

    The officers of a prospect who filed nothing share one row with a null author and zero counts. It takes part in the
    later joins on the prospect alone, so it has to stay.
    """
    author = F.when(filed, F.col("officer_id")).alias("author_id")
    totals = [F.sum(F.coalesce(F.col(weight) * F.col(c), F.lit(0))).alias(c) for c in counts]
    return held.groupBy("prospect_id", author).agg(*totals, *[F.max(d).alias(d) for d in dates])


def per_prospect(
    cohort: DataFrame, tallies: DataFrame, counts: list[str], dates: tuple[str, ...] = ()
) -> DataFrame:
    """Tallies per cohort prospect over all authors, times the prospect's cohort rows."""
    totals = tallies.groupBy("prospect_id").agg(
        *[F.sum(c).alias(c) for c in counts], *[F.max(d).alias(d) for d in dates]
    )
    counted = [F.coalesce(F.col("rows") * F.col(c), F.lit(0)).alias(c) for c in counts]
    return cohort_rows_per_prospect(cohort).join(totals, "prospect_id", "left").select("prospect_id", *counted, *dates)


def contacts_by_officer(held: DataFrame) -> DataFrame:
    """Contacts, visits and latest visit by the cohort's own officers, all time."""
    return per_author(held, COVERAGE, F.col("contacts").isNotNull(), dates=("latest_visit",))


def recent_contacts_by_officer(held: DataFrame) -> DataFrame:
    """Contacts and visits by the cohort's own officers in the rolling window."""
    return per_author(held, RECENT, F.col("recent_contacts") > 0)


def contacts_by_prospect(cohort: DataFrame, tallies: DataFrame) -> DataFrame:
    """Contacts and visits by anyone, all time and in the rolling window, and the latest visit."""
    return per_prospect(cohort, tallies, COVERAGE + RECENT, dates=("latest_visit",))


def officer_activity(cohort: DataFrame, t: Tables, p: ReportParams, priority: str | None = None) -> DataFrame:
    """Window activity per (prospect, author) by the cohort's own officers, for all rows or one priority."""
    weight = {None: "rows", "PQ": "pq_rows", "PM": "pm_rows"}[priority]
    pairs = cohort_pairs(cohort).where(F.col(weight) > 0)
    held = by_cohort_officer(pairs, activity_tallies(t, p))
    return per_author(held, ACTIVITY, F.col("reports").isNotNull(), weight)


def any_officer_activity(cohort: DataFrame, t: Tables, p: ReportParams) -> DataFrame:
    """Window activity per cohort prospect by anyone."""
    return per_prospect(cohort, activity_tallies(t, p), ["contacts", "visits", "ask_or_special", "ask", "special"])


def first_ask(cohort: DataFrame, t: Tables) -> DataFrame:
    """Per (prospect, officer, start): the officer's first ask on or after the start, null where there is none.

    ``visits`` counts the ask visits between the two dates. No ask lies between the start and the first ask, so these
    are the visits at the very moment of that ask, and travel with it.
    """
    keys = ["prospect_id", "officer_id"]
    starts = cohort.select(*keys, "start_date").distinct()
    asks = (
        t.contact_report.where((F.col("contact_purpose_code") == "A") & F.col("contact_date").isNotNull())
        .groupBy("prospect_id", F.col("author_id_number").alias("officer_id"), F.col("contact_date").alias("at"))
        .agg(F.count(F.when(F.col("contact_type") == "V", F.col("report_id"))).alias("visits"))
        .join(starts.select(*keys).distinct(), keys, "left_semi")
        .select(*keys, "at", F.struct("at", "visits").alias("ask"))
    )
    none = F.lit(None).cast(asks.schema["ask"].dataType)
    begun = starts.dropna(subset=["start_date"]).select(*keys, F.col("start_date").alias("at"), none.alias("ask"))
    found = (
        with_next_event(begun.unionByName(asks), keys, "at", "ask", "next_ask", include_self=True)
        .where(F.col("ask").isNull())
        .select(*keys, F.col("at").alias("start_date"), "next_ask")
    )
    undated = starts.where(F.col("start_date").isNull()).withColumn("next_ask", none)
    return found.unionByName(undated).select(
        *keys,
        "start_date",
        F.col("next_ask.at").alias("ask_date"),
        F.coalesce("next_ask.visits", F.lit(0)).alias("visits"),
    )


def visits_to_ask(asks: DataFrame) -> DataFrame:
    """Visits until the ask per prospect, over all its officers and starts."""
    return asks.groupBy("prospect_id").agg(F.sum("visits").alias("visits"))


def last_qualification(t: Tables) -> DataFrame:
    """The newest qualifying outcome per prospect."""
    reports = t.contact_report.where(is_.is_qualification()).select("prospect_id", "contact_outcome", "contact_date")
    return latest_by(reports, ["prospect_id"], "contact_date", ["contact_outcome"])


def officer_entity_visits(cohort: DataFrame, t: Tables, p: ReportParams) -> DataFrame:
    """Visits in the window per (officer of the cohort, entity)."""
    officers = cohort.select("officer_id").distinct()
    return (
        t.contact_report.where(is_.is_visit() & is_.in_window("contact_date", p.window))
        .groupBy(F.col("author_id_number").alias("officer_id"), F.col("id_number").alias("entity_id"))
        .agg(F.count("report_id").alias("visits"))
        .join(officers, "officer_id", "left_semi")
    )


def not_held(visited: DataFrame, t: Tables) -> DataFrame:
    """Rows whose entity the officer does not hold. Neither distinct holdings nor the cohort are needed to tell."""
    held = held_entities(t).select("officer_id", "entity_id")
    return visited.join(held, ["officer_id", "entity_id"], "left_anti")


def outside_entities(
    cohort: DataFrame, t: Tables, p: ReportParams, anti: bool = True, window: DataFrame | None = None
) -> DataFrame:
    """Entities visited per officer, without those the officer holds unless ``anti`` is off.

    From ``window`` (``window_activity``), where it is given, all authors are counted: a caller that joins its officers
    to the counts needs no join with the cohort before.
    """
    visited = officer_entity_visits(cohort, t, p) if window is None else entity_visits_of(window)
    if anti:
        visited = not_held(visited, t)
    return visited.groupBy("officer_id").agg(F.count("*").alias("entities"))


def visits_by_author(t: Tables, p: ReportParams) -> DataFrame:
    """Visits per author, split by whether the author manages the prospect.

    A visit counts once per active manager assignment of its prospect, and once if there is none; and again for every
    row that an author has under one name, because the published query joins names before it counts.
    """
    visits = (
        t.contact_report.where(is_.is_visit() & is_.in_window("contact_date", p.om_window))
        .groupBy("author_id_number", "prospect_id")
        .agg(F.count("*").alias("visits"))
    )
    staff = t.staff.select(F.col("id_number").alias("staff_id"))
    managed = (
        t.prospect.select("prospect_id")
        .join(
            t.assignment.where(is_.is_assignment("LM")).select("prospect_id", "assignment_id_number", "priority_code"),
            "prospect_id",
        )
        .join(staff, F.col("assignment_id_number") == F.col("staff_id"), "left")
        .groupBy("prospect_id", F.col("staff_id").alias("author_id_number"))
        .agg(F.count("*").alias("rows"), F.count_if(is_.has_priority("PQ")).alias("pq_rows"))
    )
    prospects = managed.groupBy("prospect_id").agg(
        F.sum(F.when(F.col("author_id_number").isNotNull(), F.col("rows")).otherwise(0)).alias("staffed"),
        F.sum(F.when(F.col("author_id_number").isNull(), F.col("rows")).otherwise(0)).alias("unstaffed"),
        F.sum("pq_rows").alias("pq_rows"),
    )
    own = managed.select("prospect_id", "author_id_number", F.col("rows").alias("own_rows"))
    visit, staffed = F.col("visits"), F.coalesce("staffed", F.lit(0))
    own_rows = F.coalesce("own_rows", F.lit(0))
    known_author = F.col("author_id_number").isNotNull()
    authors = (
        visits.join(own, ["prospect_id", "author_id_number"], "left")
        .join(prospects, "prospect_id", "left")
        .groupBy("author_id_number")
        .agg(
            F.sum(visit * own_rows).alias("visits_by_rm"),
            F.sum(F.when(known_author, visit * (staffed - own_rows)).otherwise(0)).alias("visits_by_non_rm"),
            F.sum(visit * F.coalesce("unstaffed", F.lit(1))).alias("no_rm"),
            F.sum(visit * F.coalesce("pq_rows", F.lit(0))).alias("visits_pq"),
        )
    )
    names = t.ucdr_bio.groupBy(
        F.col("id_number").alias("author_id_number"), F.col("sort_name").alias("author_name")
    ).agg(F.count("*").alias("name_rows"))
    name_rows = F.coalesce("name_rows", F.lit(1))
    return authors.join(names, "author_id_number", "left").select(
        F.col("author_id_number").alias("author_id"),
        "author_name",
        *[(F.col(c) * name_rows).alias(c) for c in ("visits_by_rm", "visits_by_non_rm", "no_rm", "visits_pq")],
    )
