"""Share of each officer's portfolio contacted and visited in the rolling window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectus.functions.dates import now, rolling_label
from prospectus.functions.scalars import share
from prospectus.operators.cohorts import cohort_pairs, prospect_cohort
from prospectus.operators.contacts import coverage_tallies
from prospectus.operators.officers import portfolio_size_raw
from prospectus.params import ReportParams
from prospectus.sources.tables import Tables

MEASURES = ("contacted_by_rm", "contacted_by_anyone", "visited_by_rm", "visited_by_anyone")


def coverage_by_officer(t: Tables, p: ReportParams) -> DataFrame:
    """Covered cohort rows per officer.

    A prospect's cohort rows meet every author row of that prospect, once for the all-time counts and once for the
    rolling ones, so a prospect with several officers counts several times. Those meetings are counted per prospect and
    multiplied; one scan of the reports serves all four measures.
    """
    cohort = prospect_cohort(t, named=False, require_active_staff=False, start="assigned")
    pairs = cohort_pairs(cohort).select("prospect_id", "officer_id", "rows")
    own = F.col("rows").isNotNull()
    met = (
        coverage_tallies(t, p)
        .join(pairs.withColumnRenamed("officer_id", "author_id"), ["prospect_id", "author_id"], "left")
        .groupBy("prospect_id")
        .agg(
            F.count_if(own).alias("authors"),
            F.count_if(own & (F.col("recent_contacts") > 0)).alias("recent_authors"),
            F.count_if(own & (F.col("recent_visits") > 0)).alias("recent_visitors"),
            F.max(F.col("recent_contacts") > 0).alias("contacted"),
            F.max(F.col("recent_visits") > 0).alias("visited"),
        )
    )
    zero = F.lit(0)
    officers, authors = F.col("officers"), F.coalesce("authors", zero)
    recent_authors, recent_visitors = F.coalesce("recent_authors", zero), F.coalesce("recent_visitors", zero)

    def author_rows(filed):
        """Author rows of the prospect: those who filed, and one more if some officer did not."""
        return filed + (officers > filed).cast("bigint")

    prospects = (
        pairs.groupBy("prospect_id")
        .agg(F.count("*").alias("officers"))
        .join(met, "prospect_id", "left")
        .select(
            "prospect_id",
            (author_rows(authors) * recent_authors).alias("contacted_by_rm"),
            (author_rows(authors) * recent_visitors).alias("visited_by_rm"),
            F.when(F.col("contacted"), author_rows(authors) * author_rows(recent_authors))
            .otherwise(zero)
            .alias("contacted_by_anyone"),
            F.when(F.col("visited"), author_rows(authors) * author_rows(recent_authors))
            .otherwise(zero)
            .alias("visited_by_anyone"),
        )
    )
    return (
        pairs.join(prospects, "prospect_id")
        .groupBy("officer_id")
        .agg(*[F.sum(F.col("rows") * F.col(m)).alias(m) for m in MEASURES])
    )


def coverage_percents(t: Tables, p: ReportParams) -> DataFrame:
    """Coverage per officer name and portfolio size: counts, and shares of the size."""
    names = t.staff.select(F.col("id_number").alias("officer_id"), F.col("sort").alias("rm_name"))
    sizes = portfolio_size_raw(t).select("officer_id", "portfolio_size")
    totals = (
        coverage_by_officer(t, p)
        .join(names, "officer_id", "left")
        .join(sizes, "officer_id", "left")
        .groupBy("rm_name", "portfolio_size")
        .agg(*[F.sum(m).alias(m) for m in MEASURES])
    )
    columns = []
    for m in MEASURES:
        columns += [F.col(m), share(F.col(m), F.col("portfolio_size")).alias(f"pct_{m}")]
    return totals.select("rm_name", "portfolio_size", *columns)


def portfolio_percents(t: Tables, p: ReportParams) -> DataFrame:
    return (
        coverage_percents(t, p)
        .withColumns({"date_pulled": now(p), "date_range": rolling_label(p)})
        .orderBy(F.col("rm_name").asc_nulls_last())
    )
