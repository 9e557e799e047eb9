"""Language of every text by a bidirectional gated recurrent network over its bytes.

Every text is laid out in windows of ``WINDOW`` bytes, the last one padded. In each window one recurrent network reads
forwards and one backwards; at every byte both states together give a probability for each language. A text's probabilities
are the mean over all its bytes, so every byte of a text of any length counts, and memory is bounded by blocks of windows.

The network is trained in numpy by backpropagation through time, with Adam, on a bounded sample: of each language the same
number of documents, some ``sample_docs`` in all (chosen by a hash), each with at most ``sample_windows`` of its windows. Only
those windows reach the driver, 2 x ``sample_docs`` x ``sample_windows`` at most (2.4 MB with the defaults); counts of languages
are the only other thing collected, for the ``most_languages`` most frequent ones. The weights travel to the tasks, which label all rows.

Null texts and texts without a letter (empty and blank ones too) are ``und`` with score 0. Very long texts run through several
blocks; repeated rows are labelled each for itself; ties go to the language that sorts first. Null languages teach nothing, nor
do rows without an id. Nothing to learn from: every text is ``und``. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, units of each direction, and the symbol that pads a text's last window.
WINDOW, UNITS, PAD = 96, 8, 256
#: Windows that are run through the network at a time.
BLOCK = 4096


@dataclass
class ByteGru:
    """One direction: input weights by byte (257 x 3 units), recurrent weights, and weights of the languages.

    Gate rows are in the order keep, reset, candidate. States are columns, one for each window.
    """

    table: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray

    @classmethod
    def random(cls, random: np.random.Generator, units: int, languages: int) -> ByteGru:
        normal = lambda *shape, scale: (random.normal(size=shape) * scale).astype(np.float32)
        return cls(normal(PAD + 1, 3 * units, scale=0.5), normal(3 * units, units, scale=units**-0.5), normal(languages, units, scale=units**-0.5))

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.out]

    def states(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For each step of ``symbols`` (steps x windows): state before, keep, reset, candidate, its recurrent part, state after."""
        units = self.recurrent.shape[1]
        state = np.zeros((units, symbols.shape[1]), dtype=self.recurrent.dtype)
        for row in symbols:
            given, own = self.table[row].T, self.recurrent @ state
            gates = 1 / (1 + np.exp(-(given[: 2 * units] + own[: 2 * units])))
            keep, reset, inner = gates[:units], gates[units:], own[2 * units :]
            candidate = np.tanh(given[2 * units :] + reset * inner)
            after = candidate + keep * (state - candidate)
            yield state, keep, reset, candidate, inner, after
            state = after

    def gradients(self, symbols: np.ndarray, steps: list[tuple[np.ndarray, ...]], logit_errors: np.ndarray) -> list[np.ndarray]:
        """Gradients of ``parts`` by backpropagation through time; ``logit_errors`` is steps x languages x windows."""
        units = self.recurrent.shape[1]
        d_recurrent, d_out = np.zeros_like(self.recurrent), np.zeros_like(self.out)
        d_given = np.empty((len(symbols), 3 * units, symbols.shape[1]), dtype=self.table.dtype)
        d_state = np.zeros((units, symbols.shape[1]), dtype=self.recurrent.dtype)
        for t in range(len(symbols) - 1, -1, -1):
            before, keep, reset, candidate, inner, after = steps[t]
            d_out += logit_errors[t] @ after.T
            d_after = d_state + self.out.T @ logit_errors[t]
            d_candidate = d_after * (1 - keep) * (1 - candidate**2)
            d_keep = d_after * (before - candidate) * keep * (1 - keep)
            d_reset = d_candidate * inner * reset * (1 - reset)
            d_given[t] = np.concatenate((d_keep, d_reset, d_candidate))
            d_own = np.concatenate((d_keep, d_reset, d_candidate * reset))
            d_recurrent += d_own @ before.T
            d_state = d_after * keep + self.recurrent.T @ d_own
        flat, rows = symbols.ravel(), d_given.transpose(0, 2, 1).reshape(-1, 3 * units)
        order = np.argsort(flat, kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        d_table = np.zeros_like(self.table)
        d_table[found] = np.add.reduceat(rows[order], first, axis=0)
        return [d_table, d_recurrent, d_out]

    def halved(self) -> ByteGru:
        """The same network with its gates' weights halved: a logistic gate is then (1 + tanh) / 2."""
        units = self.recurrent.shape[1]
        scale = np.repeat(np.array([0.5, 1], dtype=self.table.dtype), [2 * units, units])
        return ByteGru(self.table * scale, self.recurrent * scale[:, None], self.out)

    def add_logits(self, symbols: np.ndarray, logits: np.ndarray) -> None:
        """Adds this direction's part to ``logits``, with few passes over memory; for a ``halved`` network."""
        units = self.recurrent.shape[1]
        state = np.zeros((units, symbols.shape[1]), dtype=self.recurrent.dtype)
        for row, logit in zip(symbols, logits, strict=True):
            given, own = self.table[row].T, self.recurrent @ state
            gates, candidate = own[: 2 * units], own[2 * units :]
            gates += given[: 2 * units]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            candidate *= gates[units:]
            candidate += given[2 * units :]
            np.tanh(candidate, out=candidate)
            state -= candidate
            state *= gates[:units]
            state += candidate
            logit += self.out @ state


@dataclass
class LanguageModel:
    """Both directions, the languages' constants, and the languages in sorted order."""

    languages: list[str]
    forwards: ByteGru
    backwards: ByteGru
    bias: np.ndarray
    fast: tuple[ByteGru, ByteGru] = field(init=False)

    def __post_init__(self):
        self.fast = self.forwards.halved(), self.backwards.halved()

    def parts(self) -> list[np.ndarray]:
        return [*self.forwards.parts(), *self.backwards.parts(), self.bias]

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """Steps x languages x windows, from ``symbols`` (steps x windows)."""
        logits = np.empty((len(symbols), len(self.languages), symbols.shape[1]), dtype=self.bias.dtype)
        logits[:] = self.bias[:, None]
        self.fast[0].add_logits(symbols, logits)
        self.fast[1].add_logits(symbols[::-1], logits[::-1])
        return soft_max(logits)

    def pooled(self, texts: Iterator[bytes]) -> np.ndarray:
        """For every text the mean of its bytes' probabilities; empty texts have zeros."""
        sums, sizes = [], []
        block = np.full((BLOCK, WINDOW), PAD, dtype=np.int16)
        owners, used = np.empty(BLOCK, dtype=np.int64), 0

        def run() -> None:
            symbols = np.ascontiguousarray(block[:used].T)
            found = self.probabilities(symbols)
            found *= (symbols != PAD)[:, None]
            of_window = found.sum(axis=0, dtype=np.float64).T
            starts = np.flatnonzero(np.diff(owners[:used], prepend=-1))
            for owner, total in zip(owners[starts], np.add.reduceat(of_window, starts, axis=0), strict=True):
                sums[owner] += total

        for owner, text in enumerate(texts):
            data = np.frombuffer(text, dtype=np.uint8)
            sums.append(np.zeros(len(self.languages)))
            sizes.append(max(len(data), 1))
            at = 0
            while at < len(data):
                part = data[at : at + (BLOCK - used) * WINDOW]
                windows, rest = divmod(len(part), WINDOW)
                block[used : used + windows] = part[: windows * WINDOW].reshape(windows, WINDOW)
                if rest:
                    block[used + windows] = PAD
                    block[used + windows, :rest] = part[windows * WINDOW :]
                    windows += 1
                owners[used : used + windows] = owner
                used += windows
                at += len(part)
                if used == BLOCK:
                    run()
                    used = 0
        if used:
            run()
        return np.array(sums).reshape(len(sums), len(self.languages)) / np.array(sizes)[:, None]


def soft_max(logits: np.ndarray) -> np.ndarray:
    """Probabilities over the second axis, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def loss_and_gradients(model: LanguageModel, symbols: np.ndarray, answers: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the bytes of ``symbols`` (steps x windows), each labelled by its window's answer, and its gradients."""
    turned = symbols[::-1]
    steps = list(model.forwards.states(symbols)), list(model.backwards.states(turned))
    logits = np.stack([model.forwards.out @ a[-1] + model.backwards.out @ b[-1] for a, b in zip(steps[0], steps[1][::-1], strict=True)])
    errors = soft_max(logits + model.bias[:, None])
    real = symbols != PAD
    n = max(int(real.sum()), 1)
    right = np.take_along_axis(errors, np.broadcast_to(answers, (len(symbols), 1, len(answers))), axis=1)[:, 0]
    loss = -float((np.log(np.maximum(right, 1e-30)) * real).sum()) / n
    np.put_along_axis(errors, np.broadcast_to(answers, (len(symbols), 1, len(answers))), (right - 1)[:, None], axis=1)
    errors *= real[:, None] / np.asarray(n, dtype=errors.dtype)
    forwards = model.forwards.gradients(symbols, steps[0], errors)
    backwards = model.backwards.gradients(turned, steps[1], errors[::-1])
    return loss, [*forwards, *backwards, errors.sum(axis=(0, 2))]


def trained(windows: np.ndarray, answers: np.ndarray, languages: list[str], rounds: int = 200, batch: int = 256, rate: float = 0.02, seed: int = 13) -> LanguageModel:
    """A model of ``windows`` (one a row) and the place of each one's language, by Adam with a falling rate."""
    random = np.random.default_rng(seed)
    model = LanguageModel(languages, *(ByteGru.random(random, UNITS, len(languages)) for _ in range(2)), np.zeros(len(languages), dtype=np.float32))
    means, squares = ([np.zeros_like(part) for part in model.parts()] for _ in range(2))
    for step in range(1, rounds + 1):
        rows = random.integers(0, len(windows), min(batch, len(windows)))
        _, gradients = loss_and_gradients(model, np.ascontiguousarray(windows[rows].T), answers[rows])
        norm = np.sqrt(sum(float((g**2).sum()) for g in gradients))
        now = rate * 0.5 * (1 + np.cos(np.pi * step / rounds)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for part, gradient, mean, square in zip(model.parts(), gradients, means, squares, strict=True):
            gradient = gradient * min(1.0, 1.0 / max(norm, 1e-12))
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient**2 - square)
            part -= (now * mean / (np.sqrt(square) + 1e-8)).astype(part.dtype)
    model.__post_init__()
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fitted(docs: DataFrame, sample_docs: int = 4_096, sample_windows: int = 3, most_languages: int = 256, rounds: int = 200) -> LanguageModel | None:
    """A model of ``docs`` (``doc_id``, ``text``, ``lang``), or None where no row has an id, a language and a letter."""
    rows = docs.where((remainder(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return None
    each = max(sample_docs // len(counts), 1)
    shares = F.create_map(*[F.lit(x) for row in counts for x in (row["lang"], (each + 3 * each**0.5 + 3) / row["count"])])
    dealt = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(2**30)) / 2**30
    chosen = rows.where(dealt < F.coalesce(shares[F.col("lang")], F.lit(0.0)))

    def cut_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for doc_id, text, lang in zip(frame["doc_id"], frame["text"], frame["lang"], strict=True):
                data = text.encode("utf-8", "replace")
                places = np.random.default_rng(int(doc_id) % 2**32).permutation(-(-len(data) // WINDOW))[:sample_windows]
                found += [(lang, data[i * WINDOW : (i + 1) * WINDOW]) for i in places.tolist()]
            yield pd.DataFrame(found, columns=["lang", "window"])

    picked = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInPandas(cut_windows, "lang string, window binary")
    sample = picked.orderBy(F.xxhash64("window"), "window", "lang").limit(2 * sample_docs * sample_windows).collect()
    languages = sorted({row["lang"] for row in sample})
    if not languages:
        return None
    windows = np.full((len(sample), WINDOW), PAD, dtype=np.int16)
    for row, window in zip(windows, sample, strict=True):
        row[: len(window["window"])] = np.frombuffer(window["window"], dtype=np.uint8)
    place = {language: i for i, language in enumerate(languages)}
    return trained(windows, np.array([place[row["lang"]] for row in sample]), languages, rounds)


def with_language(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the pooled probability of that language; earlier such columns are replaced."""

    @F.pandas_udf("lang_pred string, score double")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = texts.notna().to_numpy()
            names, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if model is not None and known.any():
                pooled = model.pooled(value.encode("utf-8", "replace") for value in texts[known])
                best = pooled.argmax(axis=1)
                names[known] = [model.languages[i] for i in best]
                scores[known] = np.clip(pooled[np.arange(len(best)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    lettered = F.when(has_letter(F.col(text)), F.col(text))
    found = docs.drop("lang_pred", "score").withColumn("labelled language", labelled(lettered))
    return found.withColumns({"lang_pred": F.col("labelled language.lang_pred"), "score": F.col("labelled language.score")}).drop("labelled language")


def document_languages(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every row, learnt from ids with remainder 0 or 2."""
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return with_language(docs.select("doc_id", "text", held_out.alias("held_out")), fitted(docs)).select("doc_id", "held_out", "lang_pred", "score")
