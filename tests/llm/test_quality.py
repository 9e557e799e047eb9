from __future__ import annotations

import zlib

import numpy as np
import pytest

from prospectus.llm.quality import QualityModel, accepted, fitted, isotonic, quality_scores, statistics, statistics_of


def text_of(i, good):
    random = np.random.default_rng(i)
    words = ["".join(random.choice(list("abcdefghij"), random.integers(2, 9))) for _ in range(60)]
    return " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words[:6]) * 8


@pytest.fixture
def labelled(spark, documents):
    rows = [(i, text_of(i, i % 5 != 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400)], "doc_id long, quality int, toxic int")
    return documents(rows), labels


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 400
    held = [row for row in rows if row["held_out"]]
    assert {row["doc_id"] for row in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(row["predicted"] == (row["doc_id"] % 5 != 0) for row in held) >= 0.97 * len(held)
    assert all(0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.7) for row in rows)


def test_held_out_labels_change_nothing(labelled, spark):
    docs, labels = labelled
    wrong = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    scores = [{r["doc_id"]: round(r["score"], 9) for r in quality_scores(docs, x).collect()} for x in (labels, wrong)]
    assert scores[0] == scores[1]


def test_normal_equations_against_one_matrix(labelled, spark):
    docs, labels = labelled
    rows = docs.join(labels, "doc_id").select(statistics("text").alias("statistics"), labels["quality"].cast("double").alias("target"))
    frame = rows.selectExpr("*", "'fit' AS fold").repartition(5)
    model = fitted(frame, waves=32)
    held = frame.toPandas()
    x = model.features(np.stack(held["statistics"].to_numpy()))
    penalty = np.diag(np.append(np.full(32, 1e-3 * len(x) / 32), 1e-9))
    weights = np.linalg.solve(x.T @ x + penalty, x.T @ held["target"].to_numpy())
    assert np.allclose(x @ weights, model.sums(np.stack(held["statistics"].to_numpy())), atol=1e-6)


def test_features_approximate_the_kernel():
    random = np.random.default_rng(0)
    size, waves = 20, 20_000
    model = QualityModel(np.zeros(size), np.ones(size), random.normal(size=(size, waves)) / np.sqrt(size), random.uniform(0, 2 * np.pi, waves))
    rows = random.normal(size=(5, size))
    features = model.features(rows)[:, :-1]
    apart = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    assert np.allclose(features @ features.T, np.exp(-apart / (2 * size)), atol=0.03)


def test_isotonic_is_the_best_monotone_fit():
    at, value, weight = np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8]), np.array([1.0, 1, 2, 1, 1, 3])
    centres, means = isotonic(at, value, weight)
    assert np.allclose(means, [0.1, (0.5 + 0.6 + 0.3) / 4, (0.9 + 2.4) / 4])
    assert (np.diff(centres) > 0).all()


def test_awkward_documents(documents, awkward, spark):
    docs = documents(awkward, extra=("score", "held_out", "quality", "fold", "target"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (4, 0), (5, 0), (None, 1), (6, 0), (7, 1), (99, 1)], "doc_id long, quality int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == len(awkward)
    assert all(0 <= row["score"] <= 1 for row in rows)
    assert [row["held_out"] for row in rows if row["doc_id"] is None] == [False]
    assert accepted(docs, labels).count() == sum(row["predicted"] for row in rows)  # each row by its own score
    assert all(np.isfinite(statistics_of(text)).all() for _, text in awkward)


def test_nothing_to_learn_from(documents, awkward, spark):
    docs, labels = documents(awkward), spark.createDataFrame([], "doc_id long, quality int")
    assert {row["score"] for row in quality_scores(docs, labels).collect()} == {0.5}
    assert accepted(docs, labels).count() == len(awkward)
    assert quality_scores(documents([], "none"), labels).count() == 0


def test_rows_are_judged_by_their_own_score(spark, documents):
    """One id on a good and a bad text, and bad texts without an id."""
    good = lambda i: f"Plain words in a sentence, number {i}, with some rest and quiet.\nAnd a second line of it, as one expects."
    bad = lambda i: f"BUY NOW!!! {i} $$$ ||| >>> CLICK CLICK CLICK ### " * 5
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(200)] + [(1, bad(1_000)), (None, bad(1_001)), (None, good(1_002))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    left = [(row["doc_id"], row["text"]) for row in accepted(documents(rows), labels).collect()]
    assert (1, good(1)) in left and (None, good(1_002)) in left
    assert not {text for _, text in left} & {bad(1_000), bad(1_001)}
