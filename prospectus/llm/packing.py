"""Packing of token sequences into windows by non-negative least squares.

Every document is cut into whole windows and one rest. The rests are counted by length (at most window - 1 counts, however
many documents). Combinations of two to four lengths that fill a window exactly are enumerated: all pairs, and an even
selection of triples and quadruples. Non-negative least squares gives each combination the number of times it is to be
used so that the used lengths come closest to the counts; the numbers are rounded and never use a length more often than it
occurs. What is left is packed greedily, longest first, window after window; a piece that meets the window's end is cut
there. Only the very last window can have padding, of any input.

The plan is a few arrays bounded by the number of combinations, not by the documents. Which rest goes where follows from
its rank among the rests of its length: a rank in its task, and the sums over the tasks before it. Nothing is ordered whole,
and no length, however common, meets in one task.

A null text is an empty one; each document has at least its end token. Repeated rows and null ids are documents of their
own. An empty table gives no pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospectus.llm.common import stored

#: Of the triples and quadruples that fill a window, one in so many is a candidate. Primes, so that every length takes part.
TRIPLES_ONE_IN, QUADRUPLES_ONE_IN = 13, 1009


def combinations_filling(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of four lengths, padded with 0, that add up to ``window``; ``present[length]`` tells which lengths occur."""
    lengths = np.flatnonzero(present)
    lengths = lengths[(lengths > 0) & (lengths < window)]
    small = lengths[lengths <= window // 2]
    pairs = np.stack((small, window - small, 0 * small, 0 * small), axis=1)
    a, b = np.meshgrid(lengths[lengths <= window // 3], small, indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    take = (a <= b) & (b <= c) & ((a + 2 * b) % TRIPLES_ONE_IN == 0)
    triples = np.stack((a[take], b[take], c[take], 0 * c[take]), axis=1)
    keep = a <= b
    a, b = a[keep], b[keep]
    found = []
    first = b + (-(a + 3 * b + 5 * b)) * pow(5, -1, QUADRUPLES_ONE_IN) % QUADRUPLES_ONE_IN  # least c >= b of the selected residue
    for c in (first, first + QUADRUPLES_ONE_IN):
        d = window - a - b - c
        take = c <= d
        found.append(np.stack((a[take], b[take], c[take], d[take]), axis=1))
    every = np.concatenate((pairs, triples, *found)).astype(np.int64)
    known = np.append(present.astype(bool), np.zeros(max(0, window + 1 - len(present)), dtype=bool))
    known[0] = True
    return every[known[every].all(axis=1)]


def non_negative_least_squares(members: np.ndarray, wanted: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that brings the members' counts closest to ``wanted``: projected gradients with momentum."""
    flat, own = members.ravel(), np.repeat(np.arange(len(members)), members.shape[1])
    real = flat > 0
    flat, own = flat[real], own[real]

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=x[own], minlength=len(wanted))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(own, weights=r[flat], minlength=len(members))

    v = np.ones(len(members))
    for _ in range(20):
        v = back(use(v))
        v /= max(norm := float(np.linalg.norm(v)), 1e-300)
    step = 0.95 / max(norm, 1.0)
    x = y = np.zeros(len(members))
    momentum = 1.0
    for _ in range(rounds):
        following = np.maximum(0, y - step * back(use(y) - wanted))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = following + (momentum - 1) / faster * (following - x)
        x, momentum = following, faster
    return x


@dataclass(frozen=True)
class WindowPlan:
    """Where the rest of a length and a rank goes: into a combination's windows, or into the greedy stream."""

    window: int
    keys: np.ndarray  # length * 2**40 + first rank, sorted
    sequence: np.ndarray  # of the first rank; one more for each further rank
    offset: np.ndarray
    greedy_rank: np.ndarray  # by length: ranks from here on are in the stream
    greedy_start: np.ndarray  # by length: place in the stream of the first such rest
    combined: int  # windows of combinations
    sequences: int  # windows in all


def plan_windows(counts: np.ndarray, window: int) -> WindowPlan:
    """The plan for ``counts[length]`` rests of each length below ``window``."""
    left = np.zeros(window + 1, dtype=np.int64)
    left[: len(counts)] = counts
    left[0] = 0
    used = np.zeros(window + 1, dtype=np.int64)
    keys, sequences, offsets, windows = [], [], [], 0
    members = combinations_filling(window, left > 0)
    if len(members):
        share = non_negative_least_squares(members, left.astype(float))
        rounded = np.diff(np.floor(np.cumsum(share) + 0.5), prepend=0).astype(np.int64)
        for i in np.flatnonzero(rounded > 0).tolist():
            own = [x for x in members[i].tolist() if x]
            need = Counter(own)
            times = min(int(rounded[i]), *(int(left[x]) // n for x, n in need.items()))
            if times <= 0:
                continue
            place = 0
            for x in own:
                keys.append(x * 2**40 + int(used[x]))
                sequences.append(windows)
                offsets.append(place)
                used[x] += times
                left[x] -= times
                place += x
            windows += times
    tokens = left * np.arange(window + 1)
    start = np.concatenate((np.cumsum(tokens[::-1])[::-1][1:], [0]))  # longest first
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    arrays = (np.array(x, dtype=np.int64)[order] for x in (keys, sequences, offsets))
    return WindowPlan(window, *arrays, used, start, windows, windows + -(-int(tokens.sum()) // window))


def place_rests(plan: WindowPlan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the rests' first tokens."""
    streamed = rank >= plan.greedy_rank[length]
    place = plan.greedy_start[length] + (rank - plan.greedy_rank[length]) * length
    sequence, offset = plan.combined + place // plan.window, place % plan.window
    at = np.flatnonzero(~streamed)
    found = np.searchsorted(plan.keys, length[at] * 2**40 + rank[at], side="right") - 1
    sequence[at] = plan.sequence[found] + rank[at] - (plan.keys[found] - length[at] * 2**40)
    offset[at] = plan.offset[found]
    return sequence, offset


def tokenized(docs: DataFrame, window: int, vocabulary: str, end_token: int, text: str = "text") -> DataFrame:
    """Ids of each document with its rank among the rests of its length in its task (``part``).

    Columns: ``doc_id``, ``doc_tokens``, ``rest`` (length), ``rank``, ``part``, ``windows_before`` (whole windows of the
    task's earlier documents) and ``ids`` (little-endian 16-bit numbers where the vocabulary allows, else 32-bit).
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(vocabulary, end_token)
        seen = np.zeros(window, dtype=np.int64)
        before = 0
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = np.array([*encode(text or ""), end_token], dtype=kind)
                rest = len(ids) % window
                rows.append((len(ids), rest, seen[rest], before, ids.tobytes()))
                seen[rest] += 1
                before += len(ids) // window
            names, kinds = ("doc_tokens", "rest", "rank", "windows_before", "ids"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            own = {name: pa.array(values, kind) for name, values, kind in zip(names, zip(*rows, strict=True), kinds, strict=True)} if rows else {}
            if own:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "part": batch.column("part")} | own)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().cast("long").alias("part"), F.col(text).alias("text"))
    return read.mapInArrow(encoded, "doc_id long, part long, doc_tokens long, rest int, rank long, windows_before long, ids binary")


def encoder(vocabulary: str, end_token: int):
    """A text's ids as the vocabulary's library gives them, and the number type that holds them.

    Where the folder has the same byte-level vocabulary as ranks, those are read: same ids, in a third of the time. A text
    that the reader of ranks refuses (a run of a million blanks exceeds its stack) goes to the library.
    """
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(vocabulary)
    library = Tokenizer.from_file(path)
    kind = "<u2" if max(library.get_vocab_size(), end_token + 1) <= 2**16 else "<u4"
    ranked = os.path.splitext(path)[0] + ".tiktoken"
    with open(path, encoding="utf-8") as file:
        split = json.load(file).get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or not os.path.exists(ranked):
        return lambda text: library.encode(text, add_special_tokens=False).ids, kind
    with open(ranked, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    special = {token.content: number for number, token in library.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            return library.encode(text, add_special_tokens=False).ids

    return encode, kind


def packed(docs: DataFrame, window: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_token: int = 1) -> DataFrame:
    """One row for each piece: ``doc_id``, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``ids`` holds the piece's tokens as little-endian unsigned 32-bit numbers. Sequences are numbered by the plan from 0,
    whole windows of long documents from above that: their numbers have gaps between tasks.
    """
    tokens = stored(tokenized(docs, window, vocabulary, end_token))
    rests = tokens.groupBy("rest", "part").agg(F.count("*").alias("n"))
    counted = rests.groupBy("rest").agg(F.sum("n").alias("n")).collect()  # at most one row for each length below the window
    counts = np.zeros(window, dtype=np.int64)
    for row in counted:
        counts[row["rest"]] = row["n"]
    plan = plan_windows(counts, window)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rests.select("rest", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_before"))
    ranked = tokens.join(offsets, ["rest", "part"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("rest", "doc_tokens", "rank", "rank_before", "part", "windows_before")}
            length = column["rest"].astype(np.int64)
            sequence, offset = place_rests(plan, length, column["rank"] + column["rank_before"])
            whole = plan.sequences + column["part"] * 2**36 + column["windows_before"]
            rows = []
            each = zip(column["doc_tokens"].tolist(), length.tolist(), sequence.tolist(), offset.tolist(), whole.tolist(), batch.column("ids"), strict=True)
            for row, (n, rest, at, place, base, ids) in enumerate(each):
                values = np.frombuffer(ids.as_py(), dtype=f"<u{len(ids.as_buffer()) // n}").astype("<u4")
                cuts = [(i * window, window, base + i, 0) for i in range(n // window)]
                first = min(rest, window - place)
                cuts += [(n - rest, first, at, place), (n - rest + first, rest - first, at + 1, 0)]
                rows += [(row, start, size, values[start : start + size].tobytes(), n, to, where) for start, size, to, where in cuts if size]
                if len(rows) >= 2000:
                    yield batch_of(batch, rows)
                    rows = []
            if rows:
                yield batch_of(batch, rows)

    def batch_of(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        at, *values = zip(*rows, strict=True)
        names = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        own = {name: pa.array(value, pa.binary() if name == "ids" else pa.int64()) for name, value in zip(names, values, strict=True)}
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(at, pa.int64()))} | own)

    return ranked.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
