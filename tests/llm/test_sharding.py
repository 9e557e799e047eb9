from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np

import pytest
from pyspark.sql import functions as F

from prospectus.llm.sharding import deal_blocks, least_moves, placed, resharded, rewrite_affected


def test_least_moves_against_brute_force():
    random = np.random.default_rng(0)
    for _ in range(30):
        old = random.integers(0, 6, 3).tolist()
        capacity = random.integers(0, 6, 3).tolist()
        capacity[0] += max(0, sum(old) - sum(capacity))
        flow = least_moves(old, capacity)
        assert [sum(row) for row in flow.tolist()] == old
        assert all(sum(flow[:, j]) <= capacity[j] for j in range(3))
        stayed = sum(flow[i][i] for i in range(3))
        best = max(sum(x) for x in itertools.product(*(range(min(a, b) + 1) for a, b in zip(old, capacity, strict=True))) if sum(capacity) - sum(x) >= sum(old) - sum(x))
        assert stayed == best


def test_blocks_are_even_and_move_little():
    random = np.random.default_rng(1)
    sizes = {(i, b): int(random.integers(1, 1000)) * (8 if i == 0 else 1) for i in range(4) for b in range(200)}
    to = deal_blocks(sizes, 4, 8)
    held = Counter()
    for key, j in to.items():
        held[j] += sizes[key]
    total = sum(sizes.values())
    assert max(held.values()) - min(held.values()) <= 0.002 * total / 8
    old = Counter()
    for (i, _), size in sizes.items():
        old[i] += size
    must = sum(max(0, old[i] - total // 8) for i in range(4))
    moved = sum(size for (i, b), size in sizes.items() if to[i, b] != i)
    assert moved <= 1.02 * must


def test_every_row_has_one_place(documents, awkward):
    rows = [(*row, None if i % 2 else "src1") for i, row in enumerate(awkward)] + [(100, "copy", "hot")] * 500 + [(200 + i, "w " * (i % 50)) for i in range(500)]
    docs = documents(rows, extra=("shard", "size", "slot"))
    out = resharded(docs, 8, 4).collect()
    assert Counter(row["doc_id"] for row in out) == Counter(row[0] for row in rows)
    texts = {row[0]: row[1] for row in rows}
    slots, held = {}, Counter()
    for row in out:
        text = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        slots.setdefault(row["shard"], []).append(row["slot"])
        held[row["shard"]] += row["size"]
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert set(slots) == set(range(8))
    largest = max(held.values())
    rest = [size for shard, size in held.items() if size < largest]
    assert largest >= 80_000 or max(rest) - min(rest) < 2_000  # one text of 80,000 bytes fills a shard


def test_rewriting_keeps_every_row(spark, documents, tmp_path):
    docs = documents([(i, "text " * (i % 9), f"src{i % 3}") for i in range(300)])
    path = str(tmp_path / "shards")
    moved = rewrite_affected(docs, path, shards=4, old_shards=3)
    written = spark.read.parquet(path)
    expected = placed(docs, 4, 3).where("shard IN (" + ",".join(map(str, moved)) + ")")
    assert Counter(tuple(r) for r in written.select("doc_id", "shard").collect()) == Counter(tuple(r) for r in expected.select("doc_id", "shard").collect())


@pytest.mark.parametrize("old, new", [(4, 2), (2, 4), (4, 4), (5, 1)])
def test_rewriting_the_layout_it_reads(spark, documents, tmp_path, old, new):
    """All rows are there once afterwards; shards that keep their rows keep their files."""
    path = str(tmp_path / "layout")
    docs = documents([(i, "text " * (1 + i % 9), "src0") for i in range(400)]).withColumn("shard", (F.col("doc_id") % old).cast("int"))
    docs.repartition("shard").write.partitionBy("shard").parquet(path)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "layout").glob("shard=*/*.parquet")}
    now = spark.read.parquet(path)
    moved = rewrite_affected(now, path, shards=new, old_shards=old, old_shard=F.col("shard"), files=2)
    written = spark.read.parquet(path)
    assert sorted(row[0] for row in written.select("doc_id").collect()) == list(range(400))
    assert {row[0] for row in written.select("shard").distinct().collect()} == set(range(new))
    sizes = [row[0] for row in written.groupBy("shard").agg(F.sum(F.length("text") + 1)).select("sum((length(text) + 1))").collect()]
    assert max(sizes) - min(sizes) < 200
    for file, time in files.items():
        shard = int(file.parent.name.split("=")[1])
        assert (file.exists() and file.stat().st_mtime_ns == time) == (shard not in moved)
    again = rewrite_affected(written, path, shards=new, old_shards=max(old, new), old_shard=F.col("shard"), files=2)
    assert sorted(row[0] for row in spark.read.parquet(path).select("doc_id").collect()) == list(range(400)) and set(again) <= set(range(new))


def test_empty_table(documents):
    assert resharded(documents([])).count() == 0
