"""Quality scores from document statistics: random Fourier features, ridge regression, isotonic calibration.

Every text is reduced to a few statistics (shares of byte classes, word and line repetition, lengths, entropy). Random
Fourier features approximate a Gaussian kernel over them; each partition sums its part of the normal equations, the parts
are added up in a tree, and the driver solves one small system. Isotonic regression on rows that the ridge has not seen
turns the sums into probabilities. Nothing but sums of bounded size leaves the executors, and all labelled rows count.

Null and empty texts have the statistics of the empty text and a score like any other; very long ones are read whole. An empty
table gives no rows. A document with several labels has
their mean; null labels count for nothing. Without any labelled row every score is 0.5. Rows that repeat an id are scored
each for itself. Null ids are never held out and have no label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectus.llm.common import cut

STATISTICS = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "log_lines", "line_length",
    "distinct_lines", "capitals", "small", "digits", "blanks", "stops", "marks", "bars", "non_ascii", "entropy", "long_words", "bare_words",
)
LETTERS = re.compile(r"[^\W\d_]+")


def statistics_of(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``; the empty text has zeros."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    words, lines = text.split(), text.split("\n")
    if not words:
        return [float(np.log1p(len(data)))] + [0.0] * (len(STATISTICS) - 1)
    size, n = len(data), len(words)
    counts = np.bincount(data, minlength=256)
    share = counts[counts > 0] / size
    seen = Counter(words)
    stops = counts[[ord(c) for c in ".,;:?'\"-()"]].sum()
    capitals, small, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    blanks, other, bars = counts[[9, 10, 13, 32]].sum(), counts[128:].sum(), counts[ord("|")]
    marks = size - stops - capitals - small - digits - blanks - other - bars
    return [
        float(x)
        for x in (
            np.log1p(size), np.log1p(n), size / n, len(seen) / n, max(seen.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
            np.log1p(len(lines)), np.log1p(size / len(lines)), len(set(lines)) / len(lines), capitals / size, small / size,
            digits / size, blanks / size, stops / size, marks / size, bars / size, other / size, -(share * np.log(share)).sum(),
            sum(len(w) > 20 for w in seen) / len(seen), sum(LETTERS.fullmatch(w) is not None for w in seen) / len(seen),
        )
    ]


def statistics(text: Column) -> Column:
    """The texts' statistics, an array of doubles."""

    @F.pandas_udf("array<double>")
    def computed(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics_of(text) for text in texts])

    return computed(text)


@dataclass(frozen=True)
class QualityModel:
    """Centre and scale of the statistics, the kernel's directions, ridge weights, and the calibration's steps."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    raw: np.ndarray | None = None
    calibrated: np.ndarray | None = None

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        standard = np.clip((rows - self.centre) / self.scale, -8, 8)
        waves = np.cos(standard @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate((waves, np.ones((len(rows), 1))), axis=1)

    def sums(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1; between two steps of the calibration they rise in a line."""
        if self.weights is None:
            return np.full(len(rows), 0.5)
        return np.clip(np.interp(self.sums(rows), self.raw, self.calibrated), 0, 1)


def isotonic(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled neighbours: centres and means of the blocks of the non-decreasing step function closest to ``value``."""
    blocks: list[list[float]] = []  # weighted place, weighted value, weight
    for x, y, w in zip(at.tolist(), value.tolist(), weight.tolist(), strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    array = np.array(blocks)
    return array[:, 0] / array[:, 2], array[:, 1] / array[:, 2]


#: Ridge sums are counted in so many steps of a thousandth for the calibration; beyond the ends they count as the ends.
LOWEST, HIGHEST, STEPS = -1.0, 2.0, 3000


def fitted(rows: DataFrame, waves: int = 256, ridge: float = 1e-3, width: float | None = None, seed: int = 7) -> QualityModel:
    """A model of ``rows``: ``statistics``, ``target`` (0 to 1) and ``fold`` (``fit`` or ``calibrate``)."""
    size = len(STATISTICS)
    moments = rows.agg(*[f(F.col("statistics")[i]) for i in range(size) for f in (F.avg, F.stddev_pop)]).first()
    if moments[0] is None:
        return QualityModel(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1))
    centre, scale = np.array(moments[0::2], dtype=float), np.array(moments[1::2], dtype=float)
    scale[scale < 1e-9] = 1
    random = np.random.default_rng(seed)
    directions = random.normal(size=(size, waves)) / (width or np.sqrt(size))
    model = QualityModel(centre, scale, directions, random.uniform(0, 2 * np.pi, waves))

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((waves + 1, waves + 2))
        for frame in frames:
            if len(frame):
                x = model.features(np.stack(frame["statistics"].to_numpy()))
                total += x.T @ np.column_stack((x, frame["target"].to_numpy()))
        yield pd.DataFrame({"part": [total.tobytes()]})

    parts = rows.where("fold = 'fit'").mapInPandas(equations, "part binary")
    total = parts.rdd.map(lambda row: np.frombuffer(row["part"])).treeReduce(np.add).reshape(waves + 1, waves + 2)
    n = total[waves, waves]
    penalty = np.diag(np.append(np.full(waves, ridge * max(n, 1) / waves), 1e-9))
    weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1]) if n else np.zeros(waves + 1)
    model = QualityModel(centre, scale, directions, model.phases, weights)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = model.sums(np.stack(frame["statistics"].to_numpy())) if len(frame) else []
            yield pd.DataFrame({"sum": own, "target": frame["target"]})

    step = F.floor((F.least(F.greatest("sum", F.lit(LOWEST)), F.lit(HIGHEST)) - LOWEST) * (STEPS / (HIGHEST - LOWEST)))
    held = rows.where("fold = 'calibrate'").mapInPandas(summed, "sum double, target double").groupBy(step.alias("step"))
    steps = held.agg(F.avg("sum").alias("at"), F.avg("target").alias("mean"), F.count("*").alias("n")).orderBy("step").collect()  # STEPS + 1 at most
    if steps:
        raw, calibrated = isotonic(*(np.array([float(row[name]) for row in steps]) for name in ("at", "mean", "n")))
    else:
        raw, calibrated = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return QualityModel(centre, scale, directions, model.phases, weights, raw, calibrated)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fitted_to(rows: DataFrame, labels: DataFrame) -> QualityModel:
    """The model of ``rows`` (``doc_id``, ``statistics``) that have labels and are not held out."""
    fold = F.when(remainder(F.col("doc_id")) == 3, "calibrate").otherwise("fit")
    known = labels.where(remainder(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.avg("quality").alias("target")).where("target is not null")
    return fitted(rows.join(known, "doc_id").select("statistics", "target", fold.alias("fold")))


def score_of(model: QualityModel) -> Column:
    """The scores of the column ``statistics``."""

    @F.pandas_udf("double")
    def scored(values: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(values.to_numpy())) if len(values) else [], dtype="float64")

    return scored("statistics")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every document.

    Labels (``doc_id``, ``quality``) are learnt from rows whose id has remainder 0 or 1 and calibrate those with
    remainder 3; remainder 2 is held out. Id, language, source and labels are no part of a score.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics(F.col("text")).alias("statistics")))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    out = rows.select("doc_id", held_out.alias("held_out"), score_of(fitted_to(rows, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; all of them where there is no label to learn from.

    Every row is judged by its own score, whatever its id, and rows without an id are judged as well. Rows are numbered by the
    scan: the input must be a table read from files.
    """
    if labels.where(remainder(F.col("doc_id")) != 2).where("quality is not null").isEmpty():
        return docs
    number = F.monotonically_increasing_id().alias("__row")
    rows = cut(docs.select(number, F.col("doc_id").cast("long").alias("doc_id"), statistics(F.col("text")).alias("statistics")))
    rejected = rows.select("__row", score_of(fitted_to(rows, labels)).alias("score")).where(F.col("score") < threshold).select("__row")
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(rejected, "__row", "left_anti").drop("__row")
