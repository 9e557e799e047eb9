"""Mixing of sources to target weights by Poisson replication.

A source's target repetition rate is its target share of the mixture's bytes over its share of the corpus. Every document
is taken k times, k being the inverse Poisson distribution of its source's rate at a number in [0, 1) hashed from the seed
and the document's id; so the choice is the same in every run and needs no state. Copies are numbered from 0 and spread
over the output by a global shuffle on a hash of seed, id and copy.

The plan holds rates only. Tasks invert the distribution by a search in its steps, which they compute once for each rate;
those are in number some 24 square roots of it. Where a rate may give a document more than ``BLOCK`` copies, such a document
is first dealt out as blocks of copies, so that no task writes all of them.

Sources that no weight names, nulls among them, form one group that shares the rest of the weights in proportion to their
bytes. Rates are computed from all documents: one row for each named source and one for the rest, at most. A document with
a null id is hashed as the empty string; rows that repeat an id are taken equally often, each for itself. An empty table
gives an empty mixture; a named source without documents gives its share to nobody.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production weights: shares of the mixture's bytes.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.08, "src3": 0.02, "src4": 0.05}
SEED = "mixture-1"

#: Copies of one document that one task writes.
BLOCK = 4096

#: Largest number of the hash, which has 12 hexadecimal digits.
_RANGE = 16**12


def hashed(*parts: Column) -> Column:
    """A whole number below 2**48 from the parts' MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def first_step(rate: float) -> int:
    """Copies below this have together less probability than the hash can tell from none."""
    return max(0, math.floor(rate - 12 * math.sqrt(rate) - 40))


def poisson_steps(rate: float) -> list[float]:
    """The distribution function at ``first_step``, and on until it is 1 to the hash's precision; one more copy beyond each."""
    steps, below, k = [], 0.0, first_step(rate)
    while rate > 0 and (below < 1 - 0.5 / _RANGE) and (k <= rate or math.exp(_log_mass(rate, k)) > 1e-18):
        below += math.exp(_log_mass(rate, k))
        steps.append(below)
        k += 1
    return steps or [1.0]


def most_copies(rate: float) -> int:
    """No document of this rate is taken more often."""
    return first_step(rate) + len(poisson_steps(rate))


@cache
def _steps(rate: float) -> tuple[int, np.ndarray]:
    return first_step(rate), np.array(poisson_steps(rate))


def copies_of(uniform: Column, rate: Column) -> Column:
    """The inverse Poisson distribution of ``rate`` at ``uniform``, as a long."""

    @F.pandas_udf("long")
    def inverse(at: pd.Series, rates: pd.Series) -> pd.Series:
        out, given = np.zeros(len(at), dtype=np.int64), rates.to_numpy()
        for each in np.unique(given):
            first, steps = _steps(float(each))
            own = given == each
            out[own] = first + np.searchsorted(steps, at.to_numpy()[own], side="right")
        return pd.Series(out)

    return inverse(uniform, rate)


def _log_mass(rate: float, k: int) -> float:
    return k * math.log(rate) - rate - math.lgamma(k + 1)


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    epochs: float = 1.0,
    seed: str = SEED,
    partitions: int | None = None,
) -> DataFrame:
    """The mixture: the rows of ``docs`` with ``copy`` (from 0) and ``shuffle_key``, in the order of that key.

    ``weights`` gives shares of the mixture's bytes (their sum at most 1; the rest goes to all other sources), ``epochs``
    the mixture's size in corpora. Columns named ``copy`` or ``shuffle_key`` in ``docs`` are replaced.
    """
    if min(weights.values(), default=0) < 0 or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must be at least 0 and sum up to at most 1")
    kept = docs.drop("copy", "shuffle_key")
    named = [name for name in sorted(weights)]
    group = F.when(F.col("source").isin(named), F.col("source")) if named else F.lit(None).cast("string")
    bytes_of = F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    sizes = {row[0]: row[1] or 0 for row in kept.groupBy(group).agg(bytes_of).collect()}  # len(weights) + 1 rows at most
    total = sum(sizes.values())
    shares = {name: weights[name] for name in named} | {None: max(0.0, 1 - sum(weights.values()))}
    rates = {name: epochs * share * total / sizes[name] if sizes.get(name) else epochs for name, share in shares.items()}
    uniform = hashed(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) / F.lit(float(_RANGE))

    rate = F.lit(rates[None])
    for name in named:
        rate = F.when(F.col("source") == name, F.lit(rates[name])).otherwise(rate)
    # a null source meets no branch above and takes the rest's rate
    taken = kept.withColumn("__n", copies_of(uniform, rate.cast("double"))).where("__n > 0")
    first, last = F.lit(0).cast("long"), F.col("__n") - 1
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if max(map(most_copies, rates.values())) > BLOCK:
        dealt = taken.withColumn("__block", F.explode(F.sequence(first, F.floor(last / BLOCK))))
        taken = dealt.withColumn("__row", F.monotonically_increasing_id()).repartition(parts, "__row", "__block").drop("__row")
        first = F.col("__block") * BLOCK
        last = F.least(last, first + (BLOCK - 1))
    copies = taken.withColumn("copy", F.explode(F.sequence(first.cast("int"), last.cast("int")))).drop("__n", "__block")
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = copies.withColumn("shuffle_key", hashed(F.lit(seed), F.lit("order"), identity, F.col("copy").cast("string")))
    # the row number spreads rows that repeat one id; it is the same when a lost task runs again
    spread = keyed.withColumn("__row", F.monotonically_increasing_id()).repartition(parts, "shuffle_key", "__row")
    return spread.drop("__row").sortWithinPartitions("shuffle_key")
