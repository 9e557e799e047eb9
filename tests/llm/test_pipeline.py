from __future__ import annotations

from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from prospectus.llm.common import components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, documents, awkward, tmp_path):
    random = np.random.default_rng(0)
    letters = list("abcdefghij")
    word = lambda: "".join(random.choice(letters, random.integers(2, 9)))
    rows = list(awkward)
    for i in range(200):
        lines = [" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(4)]
        rows.append((1_000 + i, "\n".join(lines) if i % 5 else " ".join(word().upper() + "!!" for _ in range(5)) * 6))
    rows += [(2_000, rows[30][1]), (2_001, rows[31][1].replace("\n", "\nBegin ", 1))]
    docs = documents(rows)
    spark.createDataFrame([(1_000 + i, int(i % 5 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frames = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{i}")
        stage(spark, frames[-1], str(tmp_path)).write.parquet(path)
        frames.append(spark.read.parquet(path))
        if i < 4:
            assert frames[-1].columns == COLUMNS, name
    after = [{row["doc_id"]: row["text"] for row in frame.collect()} for frame in frames[:5]]
    good = [1_000 + i for i in range(200) if i % 5]
    assert sum(i in after[1] for i in good) >= 0.97 * len(good)
    assert sum(1_000 + i in after[1] for i in range(0, 200, 5)) <= 2
    assert 2_000 not in after[2] or not after[2][2_000].strip() or 1_019 not in after[1]
    assert set(after[3]) <= set(after[2])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(library.encode(row["text"] or "", add_special_tokens=False).ids) + 1 for row in frames[4].collect())
    pieces = frames[5].collect()
    assert sum(piece["length"] for piece in pieces) == tokens
    filled = defaultdict(int)
    for piece in pieces:
        filled[piece["sequence_id"]] += piece["length"]
    assert max(filled.values()) <= 2048


def test_empty_tables(spark, documents, tmp_path):
    docs = documents([])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in names}
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_components(spark):
    random = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1_000, 1_060)] + [(5_000, 6_000 + i) for i in range(100)] + [(None, 3), (7, 7)]
    low = {}
    links = [(a, b) for a, b in pairs if a is not None and a != b]
    for a, b in links:
        low[a], low[b] = a, b
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(low[a], low[b])
            if low[a] != least or low[b] != least:
                low[a] = low[b] = least
                changed = True
    found = {row["node"]: row["component"] for row in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == low
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
