from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prospectus.llm import packing
from prospectus.llm.packing import combinations_filling, non_negative_least_squares, packed, place_rests, plan_windows

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("window", [64, 2048])
def test_round_trip(documents, awkward, window):
    rows = awkward + [(100 + i, "lorem ipsum dolor " * (i % 37)) for i in range(150)]
    docs = documents(rows, extra=("part", "rest", "rank", "ids"))
    pieces = packed(docs, window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for piece in pieces:
        assert piece["length"] > 0
        by_doc[piece["doc_id"]].append(piece)
        by_sequence[piece["sequence_id"]].append(piece)
    single = [row for row in rows if sum(r[0] == row[0] for r in rows) == 1]
    for doc, text in single:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[doc], key=lambda p: p["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own]).tolist() == ids
        assert [p["start"] for p in own] == [0, *itertools.accumulate(p["length"] for p in own)][:-1]
        assert {p["doc_tokens"] for p in own} == {len(ids)}
    assert sum(p["length"] for p in by_doc[1]) == 2 * by_doc[1][0]["doc_tokens"]  # the repeated row is a document of its own
    filled = []
    for own in by_sequence.values():
        at = 0
        for piece in sorted(own, key=lambda p: p["offset"]):
            assert piece["offset"] == at
            at += piece["length"]
        filled.append(at)
    assert max(filled) == window
    assert sum(x < window for x in filled) <= 1


def test_empty_table(documents):
    assert packed(documents([])).count() == 0


def test_combinations_fill_the_window():
    every = combinations_filling(200, np.ones(200))
    assert (every.sum(axis=1) == 200).all()
    assert len({tuple(row) for row in every.tolist()}) == len(every)
    assert {tuple(row[:2]) for row in every.tolist() if not row[2]} == {(a, 200 - a) for a in range(1, 101)}
    present = np.zeros(200)
    present[[50, 150]] = 1
    assert {tuple(row) for row in combinations_filling(200, present).tolist()} <= {(50, 150, 0, 0), (50, 50, 50, 50)}


def test_least_squares_against_a_known_solution():
    members = np.array([[1, 3, 0], [2, 2, 0], [1, 1, 2]])
    x = np.array([5.0, 0.0, 7.0])
    wanted = np.array([0, 19, 7, 5], dtype=float)
    assert np.allclose(non_negative_least_squares(members, wanted, 3000), x, atol=1e-3)


def test_most_rests_use_combinations():
    random = np.random.default_rng(1)
    counts = np.bincount(random.integers(1, 2048, 100_000), minlength=2048)
    plan = plan_windows(counts, 2048)
    assert plan.combined > 0.7 * plan.sequences
    used = np.zeros((plan.sequences + 1, 2048), dtype=np.int8)
    for length in range(1, 2048):
        ranks = np.arange(counts[length])
        sequence, offset = place_rests(plan, np.full(len(ranks), length), ranks)
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            first = min(length, 2048 - o)
            used[s, o : o + first] += 1
            used[s + 1, : length - first] += 1
    assert used.max() == 1
    assert (used[: plan.sequences - 1] == 1).all()


def test_one_length_holds_everything():
    counts = np.zeros(2048, dtype=np.int64)
    counts[1500] = 1000
    plan = plan_windows(counts, 2048)
    assert plan.sequences == -(-1500 * 1000 // 2048)


def test_ids_are_the_librarys():
    encode, kind = packing.encoder("byte_bpe_50k.json", 1)
    for text in ("", "a<|endoftext|> b", "Größe 漢字 😀  \x1c don't", "x" * 5000):
        assert list(encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert kind == "<u2"


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_a_million_blanks_are_encoded(blank):
    encode, _ = packing.encoder("byte_bpe_50k.json", 1)
    text = "a" + blank * 1_000_100 + "b<|endoftext|>"
    assert list(encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids
