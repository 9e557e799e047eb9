from __future__ import annotations

import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prospectus.llm import mixing
from prospectus.llm.mixing import copies_of, first_step, mixed, most_copies, poisson_steps


def test_poisson_steps_are_the_distribution():
    for rate in (0.3, 2.5, 40.0, 2000.0):
        steps = poisson_steps(rate)
        masses = [b - a for a, b in zip([0.0, *steps], steps, strict=False)]
        assert math.isclose(sum((first_step(rate) + k) * m for k, m in enumerate(masses)), rate, rel_tol=1e-6)
        assert math.isclose(steps[-1], 1, abs_tol=1e-9)
    assert poisson_steps(0) == [1.0]


def test_shares_follow_the_weights(documents):
    rows = [(i, "word " * (1 + i % 7), f"src{i % 3}") for i in range(6_000)]
    out = mixed(documents(rows), {"src0": 0.6, "src1": 0.1}, epochs=2.0)
    size = Counter()
    for row in out.collect():
        size[row["source"]] += len(row["text"])
    total = sum(size.values())
    corpus = sum(len(text) for _, text, _ in rows)
    assert abs(total / corpus - 2) < 0.1
    for source, share in (("src0", 0.6), ("src1", 0.1), ("src2", 0.3)):
        assert abs(size[source] / total - share) < 0.03


def test_awkward_documents(documents, awkward):
    rows = [(*row, None if (row[0] or 0) % 3 else "src1") for row in awkward]
    docs = documents(rows, extra=("copy", "shuffle_key", "grp"))
    first, second = mixed(docs).collect(), mixed(docs).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, second))
    assert {row["grp"] for row in first} == {"x"}
    copies = Counter((row["doc_id"], row["copy"]) for row in first)
    assert all(copies[d, c] % 2 == 0 for d, c in copies if d == 1)  # the repeated row, as often as its double
    for (d, c), _ in copies.items():
        assert c == 0 or (d, c - 1) in copies


def test_a_weight_of_zero_and_no_weights(documents):
    rows = [(i, "text", "src0" if i % 2 else "src1") for i in range(200)]
    assert {row["source"] for row in mixed(documents(rows), {"src0": 0.0}).collect()} == {"src1"}
    assert 120 < mixed(documents(rows), {}).count() < 280
    with pytest.raises(ValueError):
        mixed(documents(rows), {"src0": 1.5})


def test_empty_table(documents):
    assert mixed(documents([])).count() == 0


def test_copies_are_the_inverse_distribution(spark):
    """Against the distribution added up from 0 copies on."""
    rates = (0.0, 0.4, 3.0, 250.0)
    rows = spark.range(0, 4_000).select((F.col("id") / 4_000).alias("at"), F.element_at(F.array(*map(F.lit, rates)), (F.col("id") % 4 + 1).cast("int")).alias("rate"))
    for row in rows.withColumn("n", copies_of(F.col("at"), F.col("rate"))).collect():
        below, k, mass = 0.0, 0, math.exp(-row["rate"])
        while below + mass <= row["at"]:
            below, k = below + mass, k + 1
            mass *= row["rate"] / k
        assert row["n"] == (k if row["rate"] else 0)


def test_a_very_high_rate_has_a_small_plan(documents):
    """A named source of one small document in a large corpus: some two million copies asked for."""
    docs = documents([(1, "a", "src0"), (2, "b" * 2_000_000, "src9")])
    start = time.monotonic()
    out = mixed(docs, {"src0": 0.5})
    planned = out._jdf.queryExecution().executedPlan().toString()
    assert time.monotonic() - start < 20 and len(planned) < 20_000
    rate = 0.5 * 2_000_001
    assert most_copies(rate) - first_step(rate) < 30 * math.sqrt(rate)
    row = out.where("doc_id = 1").agg(F.count("*"), F.countDistinct("copy"), F.max("copy"), F.min("copy")).first()
    assert row[0] == row[1] == row[2] + 1 and row[3] == 0 and abs(row[0] - rate) < 6 * math.sqrt(rate)


def test_blocks_of_copies_change_nothing(documents, monkeypatch):
    rows = [(i % 40, f"text {i % 7}", f"src{i % 3}") for i in range(90)]
    whole = sorted(map(repr, mixed(documents(rows), {"src0": 0.9}, epochs=12.0).collect()))
    monkeypatch.setattr(mixing, "BLOCK", 5)
    assert sorted(map(repr, mixed(documents(rows), {"src0": 0.9}, epochs=12.0).collect())) == whole
