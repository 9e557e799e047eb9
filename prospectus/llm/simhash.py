"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprint: one bit for each of 64 positions, set where more than half of the XXH64 hashes of a text's word shingles have
it set. Two texts are linked when their fingerprints differ in at most three bits.

Candidates: by the pigeonhole principle one 32-bit half of two linked fingerprints differs in one bit at most. A half is a
23-bit word and nine bits beside it. If the differing bit is beside the word, the word is a key as it stands. If it is in
the word, the perfect Golay code [23, 12, 7] gives a shared key: a word within two bits of a codeword has that codeword's
index, any other the indices of its codeword at three bits and of the five at four bits, and two words that differ in one
bit always share one; the nine bits complete the key. That is at most 14 keys for a fingerprint, whatever the table's size.
Fingerprints that share a key are compared bit by bit where they meet, and only links that join two groups leave the task:
a group of n near copies gives fewer than n links for each key, not all pairs. The fingerprints of a key that more than
``CROWD`` share are dealt into blocks of about half as many; each two blocks meet in a group of their own, so a group holds
about ``CROWD`` fingerprints however many share a key.

Equal fingerprints are one node from the start. Nulls and texts without words have fingerprint zero and are linked like
any other; texts of fewer words than a shingle have one shingle. Rows with a null id have a fingerprint and the component
of their equals that have an id, null if none has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectus.llm.common import components, cut

#: Fixed value: the generator polynomial of the perfect Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101

#: Fingerprints read at once, and those of one group compared.
CHUNK = 1 << 20
CROWD = 1 << 14


def fingerprint_of(text: str | None, words_per_shingle: int, seed: int) -> int:
    """The text's fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    joined, size = b" ".join(words), words_per_shingle
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        block = np.array(hashes[i : i + 8192], dtype="<u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, words_per_shingle: int = 3, seed: int = 42) -> Column:
    """64-bit fingerprints of the texts, as longs."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(text, words_per_shingle, seed) for text in texts], dtype="int64")

    return hashed(text)


class Golay:
    """Codeword indices near a 23-bit word."""

    def __init__(self):
        self.leader = np.zeros(2048, dtype=np.int32)  # by syndrome: the error pattern of up to three bits
        self.weight = np.zeros(2048, dtype=np.int8)
        self.fours = np.zeros((2048, 5), dtype=np.int32)  # by syndrome: the patterns of four bits, where the leader has three
        found = np.zeros(2048, dtype=np.int64)
        for weight in range(5):
            patterns = np.array([sum(1 << i for i in chosen) for chosen in combinations(range(23), weight)], dtype=np.int32)
            for pattern, syndrome in zip(patterns.tolist(), self.syndrome(patterns).tolist(), strict=True):
                if weight < 4:
                    self.leader[syndrome], self.weight[syndrome] = pattern, weight
                elif self.weight[syndrome] == 3:
                    self.fours[syndrome, found[syndrome]] = pattern
                    found[syndrome] += 1

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        """The remainder of the words after division by the generator."""
        rest = words.astype(np.int32, copy=True)
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, np.int32(GENERATOR << (bit - 11)), np.int32(0))
        return rest

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and codeword indices: one for a word within two bits of a codeword, six for any other."""
        syndromes = self.syndrome(words)
        near = (words ^ self.leader[syndromes]) >> 11
        far = np.flatnonzero(self.weight[syndromes] == 3)
        more = (words[far, None] ^ self.fours[syndromes[far]]) >> 11
        return np.concatenate((np.arange(len(words)), np.repeat(far, 5))), np.concatenate((near, more.ravel()))


def keys_of(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of 64-bit fingerprints; two that differ in at most three bits share a key."""
    rows, keys = [], []
    unsigned = prints.view(np.uint64)
    for half in range(2):
        part = (unsigned >> np.uint64(32 * half)).astype(np.int64) & 0xFFFFFFFF
        word, beside = (part & 0x7FFFFF).astype(np.int32), part >> 23
        at, index = golay.indices(word)
        rows += [at, np.arange(len(prints))]
        keys += [(half << 1) << 24 | index.astype(np.int64) << 9 | beside[at], (half << 1 | 1) << 24 | word.astype(np.int64)]
    return np.concatenate(rows), np.concatenate(keys)


def joining_links(keys: np.ndarray, prints: np.ndarray, nodes: np.ndarray, most_bits: int) -> tuple[list[int], list[int]]:
    """Links that join the rows of equal keys (``keys`` is sorted) into the groups that all links give."""
    size = len(keys)
    parent = np.arange(size)
    ends = np.searchsorted(keys, keys, side="right")
    unsigned, a, b, step = prints.view(np.uint64), [], [], 1
    active = np.flatnonzero(ends > np.arange(size) + 1)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    while len(active):
        other = active + step
        close = np.bitwise_count(unsigned[active] ^ unsigned[other]) <= most_bits
        left, right = active[close], other[close]
        apart = parent[left] != parent[right]
        for i, j in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
            i, j = root(i), root(j)
            if i != j:
                parent[j] = i
                a.append(nodes[i])
                b.append(nodes[j])
        if len(left):
            for _ in range(64):  # flat again, so that the test above sees most joined pairs
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
        step += 1
        active = active[ends[active] > active + step]
    return a, b


def near_links(prints: DataFrame, most_bits: int = 3) -> DataFrame:
    """Links (``a``, ``b``) that connect the distinct fingerprints (``fingerprint``, ``node``) as all links do."""
    if not 0 <= most_bits <= 3:
        raise ValueError("halves share a key for up to three differing bits")

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        golay = Golay()
        for frame in frames:
            own = frame["fingerprint"].to_numpy(np.int64)
            rows, keys = keys_of(own, golay)
            yield pd.DataFrame({"key": keys, "fingerprint": own[rows], "node": frame["node"].to_numpy(np.int64)[rows]})

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def links(frame: pd.DataFrame) -> pd.DataFrame:
            columns = [frame[name].to_numpy(np.int64) for name in ("key", "fingerprint", "node")]
            a, b = joining_links(*columns, most_bits)
            return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows >= CHUNK:
                whole = pd.concat(held, ignore_index=True)
                last = whole["key"].to_numpy()[-1]
                cut_at = int(np.searchsorted(whole["key"].to_numpy(), last))  # the last key may go on
                if cut_at:
                    yield links(whole.iloc[:cut_at])
                held, rows = [whole.iloc[cut_at:]], 0
        if held:
            yield links(pd.concat(held, ignore_index=True))

    keys = cut(prints.select("fingerprint", "node").mapInPandas(keyed, "key long, fingerprint long, node long"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = in_groups(keys, CROWD).repartition(parts, "key").sortWithinPartitions("key")
    return met.mapInPandas(linked, "a long, b long").distinct()


def in_groups(keys: DataFrame, crowd: int) -> DataFrame:
    """Rows of ``keys``, those of a key of more than ``crowd`` rows once for each group that compares them.

    A crowded key's rows fall into blocks by their fingerprint; a group is a pair of different blocks, and its number, a hash of
    the key and both, takes the key's place. Any two rows of a key share a group. Groups that share a number by chance are
    compared with each other as well, which changes no link.
    """
    counts = keys.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > crowd)
    crowded = cut(counts.select("key", F.ceil(2 * F.col("held") / crowd).cast("int").alias("blocks")))
    if crowded.isEmpty():
        return keys
    own, others = F.pmod(F.xxhash64(F.lit("block"), "fingerprint"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = keys.join(crowded, "key").withColumn("own", own).withColumn("other", F.explode(others)).where("own <> other")
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    return keys.join(crowded, "key", "left_anti").unionByName(dealt.select(group, "fingerprint", "node"))


def simhash_components(docs: DataFrame, words_per_shingle: int = 3, most_bits: int = 3, seed: int = 42, row: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable through links, the document's own included.
    """
    prints = cut(docs.select(F.col(row).cast("long").alias("doc_id"), fingerprint(F.col(text), words_per_shingle, seed).alias("fingerprint")))
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")).where("node is not null"))
    groups = components(near_links(nodes, most_bits))
    of = nodes.join(groups, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return prints.join(of, "fingerprint", "left").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, words_per_shingle: int = 3, most_bits: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest id, of equal ids the first of the scan; null ids come last.

    Rows are compared as rows: different texts under one id all stay, and rows without an id take part as any other. They are
    numbered by the scan: the input must be a table read from files.
    """
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    groups = simhash_components(numbered, words_per_shingle, most_bits, seed, row="__row").select(F.col("doc_id").alias("__row"), "component_id")
    ids = numbered.select("__row", F.col("doc_id").isNull().alias("unknown"), "doc_id")
    first = F.min(F.struct("unknown", "doc_id", "__row")).alias("first")
    kept = groups.join(ids, "__row").groupBy("component_id").agg(first).select("first.__row")
    return numbered.join(kept, "__row", "left_semi").drop("__row")
