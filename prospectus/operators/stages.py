"""Stage history: how long prospects and proposals have been at a stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectus.functions import predicates as is_
from prospectus.functions.dates import MICROS_PER_DAY, micros_between, now, years_between
from prospectus.operators.ranking import latest_by, with_next_event
from prospectus.params import ReportParams
from prospectus.sources.tables import Tables


def proposal_stage_intervals(t: Tables, proposals: DataFrame | None = None) -> DataFrame:
    """Stage entries per proposal with the next strictly later stage date; entries on one date share it.

    Equal entries are counted first (``entries``) and a date's codes are held in one row, so only distinct dates are
    searched and nothing is joined back. ``proposals`` limits the search to the proposals it lists.
    """
    counted = (
        t.stage.where(F.col("proposal_id").isNotNull())
        .groupBy("proposal_id", "stage_date", "stage_code")
        .agg(F.count("*").alias("entries"))
    )
    if proposals is not None:
        counted = counted.join(proposals.select("proposal_id"), "proposal_id", "left_semi")
    # one element for each code of the date
    dates = counted.groupBy("proposal_id", "stage_date").agg(
        F.collect_list(F.struct("stage_code", "entries")).alias("_codes")
    )
    dates = dates.withColumn("_event", F.col("stage_date"))
    following = with_next_event(dates, ["proposal_id"], "stage_date", "_event", "next_date", include_self=False)
    return following.select("proposal_id", "stage_date", "next_date", F.explode("_codes").alias("_code")).select(
        "proposal_id", "_code.stage_code", "stage_date", "next_date", "_code.entries"
    )


def _spent(p: ReportParams) -> Column:
    """Microseconds of a row's entries, until the next stage or now. Decimal, so that sums are exact and never wrap."""
    spent = micros_between(F.col("stage_date"), F.coalesce("next_date", now(p))).cast("decimal(20,0)")
    return spent * F.col("entries").cast("decimal(18,0)")


def _days(micros: Column) -> Column:
    """Microseconds as days. Divided once after summing, so the order of rows does not matter."""
    return micros.cast("double") / F.lit(float(MICROS_PER_DAY))


def days_per_stage(t: Tables, p: ReportParams, proposals: DataFrame | None = None) -> DataFrame:
    """Days per (proposal, stage code); the last stage runs to now."""
    intervals = proposal_stage_intervals(t, proposals)
    return intervals.groupBy("proposal_id", "stage_code").agg(_days(F.sum(_spent(p))).alias("days"))


def stage_days(t: Tables, p: ReportParams, proposals: DataFrame | None = None) -> DataFrame:
    """Days per proposal with one column per stage code, in one pass over the intervals."""
    intervals = proposal_stage_intervals(t, proposals).withColumn("_spent", _spent(p))
    columns = [
        _days(F.sum(F.when(F.col("stage_code") == code, F.col("_spent")))).alias(f"days_{code.lower()}")
        for code in is_.PROPOSAL_STAGES
    ]
    return intervals.groupBy("proposal_id").agg(*columns)


def newest_entries(t: Tables, codes: tuple[str, ...]) -> DataFrame:
    """The newest entry per (prospect, proposal, stage code), of the given codes, in one pass over the history.

    ``entry`` orders as ``latest_by`` does (date added, then stage date, nulls first), so entries of a prospect or proposal
    alone are the greatest of it. Unknown prospects and proposals stay null.
    """
    added, staged = F.col("date_added"), F.col("stage_date")
    entry = F.struct(added.isNull().alias("unknown_added"), added, staged.isNull().alias("unknown_staged"), staged)
    chosen = t.stage.where(F.col("stage_code").isin(*codes))
    return chosen.groupBy("prospect_id", "proposal_id", "stage_code").agg(F.max(entry).alias("entry"))


def _newest(t: Tables, keys: list[str], entries: DataFrame | None) -> DataFrame:
    """Keys with the stage date of the newest entry, from ``newest_entries`` where they are given."""
    if entries is not None:
        found = entries.dropna(subset=keys).groupBy(*keys).agg(F.max("entry").alias("entry"))
        return found.select(*keys, "entry.stage_date")
    rows = t.stage.select(*keys, "date_added", "stage_date")
    return latest_by(rows, keys, "date_added", ["stage_date"]).drop("date_added")


def time_at_stage(cohort: DataFrame, t: Tables, p: ReportParams, entries: DataFrame | None = None) -> DataFrame:
    """When each cohort prospect entered its current stage, credited to one officer only.

    All officers of a prospect see the same newest entry, so the credited row is that entry with the first officer id.
    ``entries`` (``newest_entries``) saves a pass over the history; stages whose code it leaves out have no date then.
    """
    holders = cohort.groupBy("prospect_id", "stage_code").agg(F.min("officer_id").alias("officer_id"))
    newest = _newest(t, ["prospect_id", "stage_code"], entries)
    return holders.join(newest, ["prospect_id", "stage_code"], "left").select(
        "prospect_id", "stage_date", "stage_code", years_between(F.col("stage_date"), now(p)).alias("years"), "officer_id"
    )


def time_at_proposal_stage(cohort: DataFrame, t: Tables, p: ReportParams, entries: DataFrame | None = None) -> DataFrame:
    """The same per major-gift proposal of the cohort's prospects."""
    keys = ["prospect_id", "proposal_id", "stage_code"]
    holders = cohort.groupBy("prospect_id").agg(F.min("officer_id").alias("officer_id"))
    proposals = t.proposal.where(is_.is_major_gift() & F.col("proposal_id").isNotNull()).select(*keys)
    return (
        holders.join(proposals, "prospect_id")
        .join(_newest(t, keys, entries), keys, "left")
        .select(*keys, "stage_date", years_between(F.col("stage_date"), now(p)).alias("years"), "officer_id")
    )
