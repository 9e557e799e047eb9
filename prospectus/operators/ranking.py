"""Latest row per key, and the next event in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order_col: str, tiebreak: list[str] | None = None) -> DataFrame:
    """The newest row per key; a null ``order_col`` ranks first. Rows with a null key never join and are left out.

    Spark keeps one row per key and map partition before the shuffle, so a key that holds much of the table sends only
    a row per partition. ``tiebreak`` lists the payload columns, descending, which makes the choice deterministic.
    """
    order = [F.col(c).desc_nulls_first() for c in [order_col, *(tiebreak or [])]]
    newest = Window.partitionBy(*keys).orderBy(*order)
    present = df.dropna(subset=keys)
    return present.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def with_next_event(
    points: DataFrame, keys: list[str], at: str, event: str, name: str, include_self: bool
) -> DataFrame:
    """Add ``name``: the least ``event`` of the key at or after (strictly after unless ``include_self``) the row's time.

    ``event`` is null on rows that are no event, and orders like ``at``. Points must be distinct per (keys, at, event).
    A key is never sorted whole: the search runs inside (key, day), and only the first event of each day is carried
    over to earlier days, so a key with a large share of all rows is spread over its days. Both windows run backwards in
    time, which keeps them running minima.

    The days are dealt out to all of ``spark.sql.shuffle.partitions``: points are narrow, and adaptive execution, going by
    shuffled bytes, would put millions of them and of whatever is made of them into one task.
    """
    day = "_day"
    points = points.withColumn(day, F.to_date(at))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    backwards = Window.partitionBy(*keys, day).orderBy(F.col(at).desc())
    if include_self:
        inside = backwards.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        inside = backwards.rowsBetween(Window.unboundedPreceding, -1)

    later_days = Window.partitionBy(*keys).orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = (
        points.groupBy(*keys, day)
        .agg(F.min(event).alias("_first"))
        .select(*keys, day, F.min("_first").over(later_days).alias("_later"))
    )
    return (
        points.repartition(tasks, *keys, day)
        .withColumn("_inside", F.min(event).over(inside))
        .join(days, [*keys, day], "left")
        .withColumn(name, F.coalesce("_inside", "_later"))
        .drop(day, "_inside", "_later")
    )
