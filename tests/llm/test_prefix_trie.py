from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from prospectus.llm.prefix_trie import chain_totals, member_hashes, prefix_trie, running
from prospectus.llm.queries import PREFIX_TRIE

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_key(turn, role, text):
    return turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def by_force(rows):
    """Nodes from dictionaries of whole paths."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn_key(turn, role, text), role or "", text or ""))
    own = {conv: [turn[1:] for turn in sorted(turns)] for conv, turns in own.items()}
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        whole[conv] = own.get(conv - conv % 20, [])[:h] + turns[h:]
    members, children, sums, out = defaultdict(list), defaultdict(list), {}, {}
    for conv, turns in whole.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [sums[child] for child in children[path]]
        sums[path] = (sum(x[0] for x in below) if below else 1, sum(x[1] for x in below) + (len(members[path]) - 1) * words)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out[min(members[path]), len(path)] = (parent, len(members[path]), len(children[path]), *sums[path], hashlib.sha256(ends.encode()).hexdigest())
    return out


def nodes(frame):
    rows = frame.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations():
    """Copies, beginnings shared to every depth, conversations inside others, awkward rows."""
    rows = []
    for conv in range(0, 120):
        kind, size = conv % 7, 1 + conv * 5 % 14
        rows += [(conv, turn, ("user", "assistant")[turn % 2], f"turn {turn} of kind {kind if turn < 9 else conv % 3} \x0b and\ttwo words") for turn in range(size)]
    rows += [(conv, turn, "user", f"the same {turn}") for conv in range(500, 560) for turn in range(6)]  # copies
    rows += [(600, turn, "user", f"long {turn}") for turn in range(150)] + [(601, turn, "user", f"long {turn}") for turn in range(149)]
    rows += [(603, turn, "user", f"long {turn}" if turn != 70 else "other") for turn in range(150)]
    rows += [(700, None, None, None), (700, None, "a", "b"), (700, 5, "", "x"), (700, 5, "", "x"), (700, 5, "x", ""), (700, -3, "user", "  ")]
    rows += [(None, 1, "user", "no conversation"), (823, 0, "user", "head without first"), (-7, 0, "user", "below zero"), (-27, 2, "user", "below")]
    rows += [(conv, 0, "user", "") for conv in range(900, 912)]
    return rows


@pytest.mark.parametrize("block", [4, 1, 3])
def test_against_whole_paths(spark, block):
    rows = [row for row in conversations() if row[0] is None or row[0] >= 0]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert nodes(prefix_trie(frame, block)) == by_force(rows)


def test_sql_on_awkward_rows(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    frame = spark.createDataFrame(conversations(), SCHEMA)
    for name in ("pos", "number", "depth", "place", "digest", "words", "part", "task", "above"):
        frame = frame.withColumn(name, F.lit("clash"))
    frame.write.parquet(path)
    connection = duckdb.connect()
    connection.sql(f"create view conversations as select * from '{path}/*.parquet'")
    expected = {(row[0], row[1]): row[2:] for row in connection.sql(PREFIX_TRIE).fetchall()}
    assert nodes(prefix_trie(spark.read.parquet(path))) == expected


def test_small_tables(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    alone = [(n, 0, "user", "x") for n in range(21, 25) if zlib.crc32(str(n).encode()) % 4 > 0][:1]  # loses its only turn, has no first one
    assert nodes(prefix_trie(spark.createDataFrame(alone, SCHEMA))) == {(alone[0][0], 0): (None, 1, 0, 1, 0, hashlib.sha256(str(alone[0][0]).encode()).hexdigest())}


def test_repeated_rows_and_long_texts(spark):
    rows = [(20, 1, "user", "word " * 200_000)] * 3 + [(21, 1, "user", "word " * 200_000)] * 3
    assert nodes(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == by_force(rows)


@pytest.mark.parametrize("backwards", [False, True])
def test_running_totals_over_parts(spark, backwards):
    rows = [(key, pos, key * 100 + pos) for key in (1, 2) for pos in range(0, 50, 1 + key)]
    frame = spark.createDataFrame(rows, "key long, pos long, value long")
    out = running(frame, ["key"], "pos", {"value": "so_far"}, F.sum, backwards, span=7).collect()
    for row in out:
        reached = [v for k, p, v in rows if k == row["key"] and (p >= row["pos"] if backwards else p <= row["pos"])]
        assert row["so_far"] == sum(reached)
    assert len(out) == len(rows)


def test_totals_of_a_tall_tree(spark):
    rows = [(0, None, 1, 5)] + [(i, i - 1 if i % 3 else i // 2, 1, i) for i in range(1, 60)]
    parent = {row[0]: row[1] for row in rows}
    expected = defaultdict(lambda: [0, 0])
    for conv, _, leaves, saved in rows:
        at = conv
        while at is not None:
            expected[at][0] += leaves
            expected[at][1] += saved
            at = parent[at]
    out = chain_totals(spark.createDataFrame(rows, "conv_id long, above long, leaves long, saved long"), F.lit(0).cast("long"))
    assert {r["conv_id"]: [r["leaves"], r["saved"]] for r in out.collect()} == dict(expected)


def test_member_lists_over_several_tasks(spark):
    rows = [(3, 1, 2, n * 7 % 50_021) for n in range(50_021)] + [(0, 0, 0, n) for n in (10, 9, 100)]
    out = {r["depth"]: r["ends_sha256"] for r in member_hashes(spark.createDataFrame(rows, "depth long, kh long, kl long, conv_id long").repartition(6)).collect()}
    assert out == {3: hashlib.sha256(",".join(map(str, range(50_021))).encode()).hexdigest(), 0: hashlib.sha256(b"9,10,100").hexdigest()}
