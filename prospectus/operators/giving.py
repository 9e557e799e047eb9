"""Gifts and pledges of the cohort's prospects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectus.functions import predicates as is_
from prospectus.operators.cohorts import cohort_rows_per_prospect
from prospectus.operators.ranking import latest_by
from prospectus.params import ReportParams
from prospectus.sources.tables import Tables


def primary_pool(t: Tables) -> DataFrame:
    """Pool rows of primary prospects, keyed by prospect_id."""
    return t.ucdr_prospect_pool.where(is_.is_primary("prim_prosp_ind")).withColumnRenamed("prosp_id", "prospect_id")


def entity_giving(t: Tables, p: ReportParams) -> DataFrame:
    """All gifts in the window per entity; undated and other kinds are not told apart here."""
    return (
        t.ucdr_giving.where(is_.in_window("date_of_record", p.window))
        .groupBy("id_number")
        .agg(F.sum("prim_amt").alias("given"))
    )


def prospect_giving(t: Tables, p: ReportParams) -> DataFrame:
    """Gifts in the window per prospect with any, through the primary pool rows; null if no amount is known."""
    entities = primary_pool(t).select("prospect_id", "id_number")
    return entities.join(entity_giving(t, p), "id_number").groupBy("prospect_id").agg(F.sum("given").alias("given"))


def giving_in_window(cohort: DataFrame, t: Tables, p: ReportParams) -> DataFrame:
    """Total giving per cohort prospect with gifts in the window, times its cohort rows."""
    total = (F.col("given") * F.col("rows")).cast("decimal(28,2)").alias("total_giving")
    return cohort_rows_per_prospect(cohort).join(prospect_giving(t, p), "prospect_id").select("prospect_id", total)


def last_gift(t: Tables) -> DataFrame:
    """Date of the newest gift or pledge per entity; an undated gift ranks first, so it makes the date null.

    Only the date is asked for, so a plain aggregate does and no entity's gifts are sorted.
    """
    undated = F.count_if(F.col("date_of_record").isNull()) > 0
    return (
        t.ucdr_giving.where(is_.is_gift_or_pledge() & F.col("id_number").isNotNull())
        .groupBy("id_number")
        .agg(F.when(~undated, F.max("date_of_record")).alias("last_gift_date"))
    )


def last_annual_fund_gift(t: Tables) -> DataFrame:
    """Date and amount of the newest annual-fund gift per entity; the larger amount wins a tie."""
    gifts = t.ucdr_giving.where(is_.is_annual_fund()).select("id_number", "date_of_record", "prim_amt")
    newest = latest_by(gifts, ["id_number"], "date_of_record", ["prim_amt"])
    return newest.withColumnsRenamed({"date_of_record": "af_last_date", "prim_amt": "af_last_amt"})
