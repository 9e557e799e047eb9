"""Joins that repeat rows many times over for a crowded key.

A report that lists every proposal of a prospect once per manager has, for one prospect, as many rows as the product of
both. The inputs of such a key can be small and its output huge, which adaptive skew handling, going by input size, does
not see. Here the rows of one side are dealt out to parts of the key, and the other sides are repeated per part. Keys
that yield an ordinary number of rows have one part and are not repeated. The list of crowded keys is found once, from
counts per key, and stored; where it is empty the join is a plain one. It is broadcast up to ``BROADCAST_KEYS`` keys, so that
looking them up shuffles nothing; a longer list, of a result of more than ``BROADCAST_KEYS * rows_per_part`` rows, is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectus.params import ROWS_PER_PART
from prospectus.sources.shared import shared

PART = "_part"

# Crowded keys (some 20 bytes each) that are broadcast at most.
BROADCAST_KEYS = 1_000_000


def crowded_keys(
    key: str, first: DataFrame, *others: DataFrame, rows_per_part: int = ROWS_PER_PART, how: str = "left"
) -> DataFrame:
    """Keys whose join yields more than ``rows_per_part`` rows, with the number of parts to deal ``first`` into.

    A key that a side lacks counts there as one row in a left join, and yields nothing in an inner one. Each crowded key
    stands for more than ``rows_per_part`` result rows, so there is at most one for so many rows of the result.
    """
    counts = [
        side.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").cast("double").alias(f"_rows{i}"))
        for i, side in enumerate([first, *others])
    ]
    joined = reduce(lambda left, right: left.join(right, key, how), counts)
    rows = reduce(lambda a, b: a * b, [F.coalesce(F.col(f"_rows{i}"), F.lit(1.0)) for i in range(len(counts))])
    parts = F.least(F.ceil(rows / rows_per_part), F.col("_rows0")).cast("int")
    return joined.where(rows > rows_per_part).select(key, parts.alias("_parts"))


def deal_out(df: DataFrame, crowded: DataFrame, key: str) -> DataFrame:
    """Each row in one part of its key. Rows that are equal in every column share a part."""
    part = F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("_parts")), F.lit(0)).cast("int")
    return df.join(crowded, key, "left").withColumn(PART, part).drop("_parts")


def repeat(df: DataFrame, crowded: DataFrame, key: str) -> DataFrame:
    """Each row once in every part of its key."""
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    return df.join(crowded, key, "left").withColumn(PART, F.explode(parts)).drop("_parts")


def fan_out_join(
    first: DataFrame,
    *others: DataFrame,
    key: str,
    how: str = "left",
    sized_by: tuple[DataFrame, ...] | None = None,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Join ``first`` with the others on ``key``, every combination of a key's rows, spread over parts of the key.

    ``sized_by`` gives narrow frames with about as many rows per key as the inputs, in the same order, where counting the
    inputs themselves would compute them twice. Sizes only decide the number of parts, not the result.
    """
    crowded = shared(crowded_keys(key, *(sized_by or (first, *others)), rows_per_part=rows_per_part, how=how))
    found = crowded.count()
    if not found:
        return reduce(lambda left, right: left.join(right, key, how), others, first)
    if found <= BROADCAST_KEYS:
        crowded = F.broadcast(crowded)
    joined = deal_out(first, crowded, key)
    for other in others:
        joined = joined.join(repeat(other, crowded, key), [key, PART], how)
    return joined.drop(PART)
