from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prospectus.llm import simhash
from prospectus.llm.common import components
from prospectus.llm.simhash import Golay, fingerprint_of, in_groups, joining_links, keys_of, near_links, one_of_each_group, simhash_components


def plain_fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, bits):
    """Smallest node reachable, by comparing all with all."""
    nodes = sorted(prints)
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if (prints[a] ^ prints[b]).bit_count() <= bits and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


def test_golay_code_covers_every_word_once():
    golay = Golay()
    assert (np.sort(golay.weight) == np.repeat([0, 1, 2, 3], [1, 23, 253, 1771])).all()
    random = np.random.default_rng(0)
    words = random.integers(0, 1 << 23, 20_000, dtype=np.int32)
    assert not golay.syndrome(words ^ golay.leader[golay.syndrome(words)]).any()
    rows, index = golay.indices(words)
    keys = [set() for _ in words]
    for row, i in zip(rows.tolist(), index.tolist(), strict=True):
        keys[row].add(i)
    assert {len(k) for k in keys} == {1, 6}
    flipped = words ^ (1 << random.integers(0, 23, len(words))).astype(np.int32)
    rows, index = golay.indices(flipped)
    shared = np.zeros(len(words), dtype=bool)
    for row, i in zip(rows.tolist(), index.tolist(), strict=True):
        shared[row] |= i in keys[row]
    assert shared.all()


def test_three_bits_apart_share_a_key():
    random = np.random.default_rng(1)
    prints = random.integers(-(2**63), 2**63, 3_000, dtype=np.int64)
    other = prints.copy()
    for _ in range(3):
        other ^= np.int64(1) << random.integers(0, 63, len(prints))
    golay = Golay()
    sets = []
    for own in (prints, other):
        found = [set() for _ in own]
        for row, key in zip(*(x.tolist() for x in keys_of(own, golay)), strict=True):
            found[row].add(key)
        sets.append(found)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_links_join_what_all_pairs_join():
    random = np.random.default_rng(2)
    prints = np.concatenate([[c ^ (1 << int(b)) for b in random.integers(0, 20, 30)] for c in (0, 0xFFFF << 30)]).astype(np.int64)
    keys = np.zeros(len(prints), dtype=np.int64)
    a, b = joining_links(keys, prints, np.arange(len(prints)), 3)
    assert len(a) == len(prints) - 2
    assert all((int(prints[i]) ^ int(prints[j])).bit_count() <= 3 for i, j in zip(a, b, strict=True))


def test_fingerprints(awkward):
    for _, text in awkward:
        assert fingerprint_of(text, 3, 42) % 2**64 == plain_fingerprint(text)


def test_components_of_awkward_documents(documents, awkward):
    base = " ".join(f"w{i}" for i in range(400))
    rows = awkward + [(20 + i, base.replace(f"w{7 * i} ", "other ") if i else base) for i in range(30)]
    docs = documents(rows, extra=("fingerprint", "node", "component_id"))
    found = simhash_components(docs).collect()
    assert len(found) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    low = grouped(prints, 3)
    for row in found:
        if row["doc_id"] is not None:
            assert (int(row["fingerprint"], 16), row["component_id"]) == (prints[row["doc_id"]], low[row["doc_id"]])
    kept = sorted(row["doc_id"] for row in one_of_each_group(docs).where("doc_id is not null").collect())
    assert kept == sorted(set(low.values()))
    assert one_of_each_group(docs).where("doc_id is null").count() == 1


def test_random_prints_against_all_pairs(spark):
    random = np.random.default_rng(3)
    centres = random.integers(-(2**63), 2**63, 40, dtype=np.int64)
    prints = {}
    for node in range(600):
        own = int(centres[random.integers(40)])
        for bit in random.integers(0, 63, random.integers(0, 5)):
            own ^= 1 << int(bit)
        prints.setdefault(own, node)
    rows = [(own, node) for own, node in prints.items()]
    frame = spark.createDataFrame(rows, "fingerprint long, node long")
    found = {row["node"]: row["component"] for row in components(near_links(frame)).collect()}
    low = grouped({node: own % 2**64 for own, node in rows}, 3)
    assert all(found.get(node, node) == low[node] for node in low)


def test_a_large_group_gives_few_links(spark):
    rows = [(sum(1 << int(b) for b in {i % 60, i // 60 % 60, 62}), i) for i in range(1, 1500)]
    frame = spark.createDataFrame(rows, "fingerprint long, node long").dropDuplicates(["fingerprint"])
    assert near_links(frame).count() < 28 * frame.count()


def test_crowded_keys_are_compared_in_bounded_groups(spark, monkeypatch):
    """Variants that share one half: every pair of a key's rows meets, no group is large, the components are those of all pairs."""
    random = np.random.default_rng(5)
    prints = {int(p): n for n, p in enumerate(random.integers(0, 1 << 9, 900) | 5 << 40)} | {int(p) << 32: 5_000 + n for n, p in enumerate(random.integers(0, 1 << 31, 200))}
    frame = spark.createDataFrame([(own, node) for own, node in prints.items()], "fingerprint long, node long")
    keyed = frame.select((F.col("node") < 5_000).cast("long").alias("key"), "fingerprint", "node")
    groups = {}
    for row in in_groups(keyed, 100).collect():
        groups.setdefault(row["key"], []).append(row["node"])
    assert max(map(len, groups.values())) < 200
    together = {(a, b) for group in groups.values() for a in group for b in group}
    crowd = [node for node in prints.values() if node < 5_000]
    assert all((a, b) in together for a in crowd for b in crowd)

    def found():
        return {row["node"]: row["component"] for row in components(near_links(frame)).collect()}

    low = grouped({node: own for own, node in prints.items()}, 3)
    for size in (simhash.CROWD, 50):
        monkeypatch.setattr(simhash, "CROWD", size)
        of = found()
        assert all(of.get(node, node) == low[node] for node in low)


def test_empty_table_and_bounds(documents, spark):
    assert simhash_components(documents([])).count() == 0
    with pytest.raises(ValueError):
        near_links(spark.range(1).select(F.col("id").alias("fingerprint"), F.col("id").alias("node")), 4)


def test_rows_not_ids_decide_what_stays(documents):
    one, other = "a first text of some seven words here", "quite another one that shares no words with it"
    rows = [(5, one), (5, other), (None, one), (None, "only once and without any id at all"), (7, one), (3, other + " indeed"), (5, one)]
    kept = [(row["doc_id"], row["text"]) for row in one_of_each_group(documents(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(5, one), (5, other), (3, other + " indeed"), (None, "only once and without any id at all")], key=str)
    nameless = one_of_each_group(documents([(None, one)] * 3 + [(None, other)], "nameless")).collect()
    assert sorted(row["text"] for row in nameless) == sorted([one, other])
