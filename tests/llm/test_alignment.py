from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prospectus.llm.alignment import Aligner, aligned_documents

NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def aligner():
    return Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")


def spelled_tokens(aligner, text):
    """(id, end) by both libraries, the second with its own spelling of bytes; None where they do not spell the text."""
    whole = (" " + text).encode()
    out = []
    for ids, spelling in ((aligner.library.encode(" " + text, add_special_tokens=False).ids, aligner.a_bytes), (aligner.pieces.encode(text), aligner.b_bytes)):
        tokens, at = [], 0
        for i in ids:
            at += len(spelling[i])
            tokens.append((i, at))
        if b"".join(spelling[i] for i in ids) != whole:
            return None
        out.append(tokens)
    return out


def by_force(aligner, rows):
    counts, found = Counter(), []
    for doc_id, text in rows:
        tokens = spelled_tokens(aligner, text) if text else None
        if tokens is None:
            found.append((doc_id, None))
            continue
        a, b = tokens
        b_by_end = {end: i for i, end in b}
        links = [(i, b_by_end[end]) for i, end in a if end in b_by_end]
        ends = sorted({end for _, end in a} & {end for _, end in b})
        groups = [(([i for i, e in a if low < e <= high]), [i for i, e in b if low < e <= high]) for low, high in zip([0, *ends[:-1]], ends, strict=True)]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        counts.update(links)
        found.append((doc_id, (len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest())))
    highest = {}
    for (_, b_id), n in counts.items():
        highest[b_id] = max(n, highest.get(b_id, 0))
    return sorted(
        (
            (doc_id, *([0] * 6), "")
            if x is None
            else (doc_id, x[0], x[1], x[2], len(x[3]), sum(counts[link] == highest[link[1]] for link in x[3]), sum(counts[link] for link in x[3]), x[4])
            for doc_id, x in found
        ),
        key=str,
    )


def rows_of(frame):
    return sorted(((row["doc_id"], *(row[name] for name in NAMES)) for row in frame.collect()), key=str)


TEXTS = [
    "Größe été niño 漢字 😀   end\r\n<|endoftext|>don't <s> </s> <unk> <0x41>",
    "▁ its own space sign",
    " leading and trailing ",
    "tab\tand\x00null ​ zero width   hard space",
    "ﬁ ligature Å é combined",
    "﻿mark first",
    "a",
    " ",
]


@pytest.mark.parametrize("block", [1, 50, 1_000_000])
def test_against_single_texts(documents, awkward, aligner, block):
    rows = [row for row in awkward if len(row[1] or "") < 20_000] + [(100 + i, text) for i, text in enumerate(TEXTS)] + [(200 + i, TEXTS[0]) for i in range(30)]
    docs = documents(rows, extra=("key", "pair", "block", "copies", "links", "n_a"))
    assert rows_of(aligned_documents(docs, block=block)) == by_force(aligner, rows)


def test_long_texts_are_whole(documents, aligner):
    long = "several words, in a long text. " * 40_000
    blank = "end" + " " * 1_100_000 + "end"
    out = {row["doc_id"]: row for row in aligned_documents(documents([(1, long), (2, blank), (3, long)])).collect()}
    assert out[1]["n_a"] == len(aligner.library.encode(" " + long, add_special_tokens=False).ids) == out[3]["n_a"]
    assert out[1]["n_b"] == len(aligner.pieces.encode(long))
    assert out[2]["n_links"] == out[2]["n_groups"] > 0


def test_fast_ids_are_the_librarys(aligner):
    for text in [*TEXTS, "<|endoftext|>", " <|endoftext|> x", "x" * 5_000, "a  b   c\n\n\nd"]:
        assert aligner.encoded(text) == aligner.library.encode(text, add_special_tokens=False).ids


def test_no_rows(documents):
    assert aligned_documents(documents([])).count() == 0
    assert rows_of(aligned_documents(documents([(1, None), (None, "")]))) == sorted([(1, *([0] * 6), ""), (None, *([0] * 6), "")], key=str)


def test_copies_are_encoded_once(documents, tmp_path):
    """Blocks hold each distinct text once, weighed by its copies."""
    from prospectus.llm.alignment import aligned_blocks, pair_counts

    docs = documents([(i, "ten equal texts" if i < 10 else "one other") for i in range(11)])
    texts = docs.groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", F.sha2("text", 256))
    blocks = aligned_blocks(texts, "byte_bpe_50k.json", "piece_bpe_32k.model")
    assert sum(len(row["keys"]) for row in blocks.collect()) == 2
    assert {row["links"] for row in pair_counts(blocks).collect()} == {10, 1}
