from __future__ import annotations

import zlib

import numpy as np
import pytest

from prospectus.llm import language
from prospectus.llm.language import PAD, WINDOW, ByteGru, LanguageModel, document_languages, fitted, loss_and_gradients, with_language

WORDS = {
    "en": "the and of to in that was with for his they this have from one had".split(),
    "de": "der die und das nicht ist mit sich auf für eine auch über nach wird".split(),
    "fr": "le les des est que dans pour qui une sur avec plus était même très".split(),
}


def model(kind=np.float64, languages=("a", "b", "c"), units=5):
    random = np.random.default_rng(3)
    made = [ByteGru.random(random, units, len(languages)) for _ in range(2)]
    for gru in made:
        gru.table, gru.recurrent, gru.out = (part.astype(kind) for part in gru.parts())
    return LanguageModel(list(languages), *made, random.normal(size=len(languages)).astype(kind))


def step_by_step(model, text: bytes):
    """Mean over the bytes of a text, one byte and one unit at a time."""
    total = np.zeros(len(model.languages))
    for start in range(0, len(text), WINDOW):
        symbols = list(text[start : start + WINDOW])
        symbols += [PAD] * (WINDOW - len(symbols))

        def read(gru, symbols):
            state, out = np.zeros(gru.recurrent.shape[1]), []
            for symbol in symbols:
                given, own = np.split(gru.table[symbol], 3), np.split(gru.recurrent @ state, 3)
                keep, reset = (1 / (1 + np.exp(-(given[i] + own[i]))) for i in (0, 1))
                state = keep * state + (1 - keep) * np.tanh(given[2] + reset * own[2])
                out.append(gru.out @ state)
            return out

        logits = np.array(read(model.forwards, symbols)) + np.array(read(model.backwards, symbols[::-1]))[::-1] + model.bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        total += (odds / odds.sum(axis=1, keepdims=True))[: len(text) - start].sum(axis=0)
    return total / max(len(text), 1)


def test_gradients_are_differences():
    net = model()
    random = np.random.default_rng(5)
    symbols = random.integers(97, 103, (7, 4))
    symbols[5:, 1] = PAD
    answers = np.array([0, 1, 2, 1])
    _, gradients = loss_and_gradients(net, symbols, answers)
    for part, gradient in zip(net.parts(), gradients, strict=True):
        for place in [tuple(random.integers(0, n) for n in part.shape) for _ in range(12)] + ([(98, 2), (PAD, 4)] if part.shape[0] == PAD + 1 else []):
            kept, losses = part[place], []
            for change in (1e-6, -1e-6):
                part[place] = kept + change
                losses.append(loss_and_gradients(net, symbols, answers)[0])
            part[place] = kept
            assert abs((losses[0] - losses[1]) / 2e-6 - gradient[place]) < 1e-6


def test_every_byte_counts(monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 3)
    net = model()
    texts = [b"", b"x", bytes(range(256)) * 3, b"y" * WINDOW, b"z" * (WINDOW * 7 + 1), b"", "été".encode() * 50]
    pooled = net.pooled(iter(texts))
    assert np.allclose(pooled, [step_by_step(net, text) for text in texts], atol=1e-9)
    assert np.allclose(pooled[[1, 2, 3, 4, 6]].sum(axis=1), 1)


def rows_of_languages(n=360):
    random = np.random.default_rng(1)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(random.choice(WORDS[lang], 30)), lang))
    return rows


@pytest.fixture(scope="module")
def learnt(spark):
    return fitted(spark.createDataFrame(rows_of_languages(), "doc_id long, text string, lang string"), rounds=40)


def test_held_out_accuracy(spark):
    rows = rows_of_languages()
    known = {row[0]: row[2] for row in rows}
    out = document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [row for row in out if row["held_out"]]
    assert {row["doc_id"] for row in held} == {i for i in known if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([known[row["doc_id"]] == row["lang_pred"] for row in held]) >= 0.97
    assert all(0 <= row["score"] <= 1 for row in out)


def test_held_out_rows_teach_nothing(spark):
    """Held-out rows may carry any language and text: the model stays the same."""
    rows = rows_of_languages(90)
    other = [(i, text, "zz") if zlib.crc32(str(i).encode()) % 3 == 1 else (i, text, lang) for i, text, lang in rows]
    models = [fitted(spark.createDataFrame(x, "doc_id long, text string, lang string"), rounds=5) for x in (rows, other, rows[::-1])]
    assert all(np.array_equal(a, b) for m in models[1:] for a, b in zip(models[0].parts(), m.parts(), strict=True))
    assert models[0].languages == sorted(WORDS)


def test_awkward_rows(spark, documents, awkward, learnt):
    rows = [*awkward, (20, "123 !!"), (21, "un " * 400_000), (22, None), (22, "les des est que")]
    docs = documents(rows, extra=("lang_pred", "score", "known"))
    out = with_language(docs, learnt).collect()
    assert len(out) == len(rows)
    for row in out:
        lettered = row["text"] is not None and any(c.isalpha() for c in row["text"])
        assert (row["lang_pred"] == "und") == (not lettered) and (lettered or row["score"] == 0.0)
        if lettered and len(row["text"]) < 1_000:
            mean = step_by_step(learnt, row["text"].encode())
            assert row["lang_pred"] == learnt.languages[int(mean.argmax())] and abs(row["score"] - mean.max()) < 1e-4
    whole = document_languages(docs)
    assert whole.columns == ["doc_id", "held_out", "lang_pred", "score"] and whole.count() == len(rows)
    assert not any(row["held_out"] for row in whole.where("doc_id is null").collect())


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert document_languages(empty).count() == 0
    rows = [(1, "some words", None), (2, None, "en"), (None, "words", "en"), (3, "?", "en")]
    out = document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(row["lang_pred"], row["score"]) for row in out} == {("und", 0.0)} and len(out) == 4


def test_one_id_for_all_rows(spark):
    """An id that many rows share neither starves the sample nor lets it grow."""
    rows = [(7, text, lang) for _, text, lang in rows_of_languages(60)] + [(7, text, lang) for _, text, lang in rows_of_languages(60)]
    assert zlib.crc32(b"7") % 3 != 1
    assert fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=12, rounds=5).languages == sorted(WORDS)
