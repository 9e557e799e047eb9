"""Token counts by byte-pair merging, without building the tokens.

Method: a word's bytes form a linked list of symbols; a heap holds every adjacent pair that has a merge rank. The pair of
the lowest rank (leftmost among equals) is popped and merged until no ranked pair is left. The count is the number of
initial symbols less the number of merges; no identifiers leave the merger.

Nulls and empty texts have 0 tokens. Texts are never cut; a word of n bytes takes O(n log n). Every row of the input is
kept, repeated ones too, with all columns it has.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The word pattern of the byte-level vocabulary, with white space as Unicode's White_Space property.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairMerger(dict):
    """Number of tokens by word; a missing word is merged when it is asked for."""

    #: Words kept for the next text; beyond that, and for words longer than KEPT_CHARS, they are merged anew each time.
    KEPT_WORDS, KEPT_CHARS = 600_000, 64

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in content["model"]["merges"]]
        self.ranks = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.symbols = [vocabulary[letter] for _, letter in sorted(byte_letters().items())]
        self.words = regex.compile(WORDS).findall
        special = [token["content"] for token in content.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None

    def __missing__(self, word: str) -> int:
        tokens = self.merged(word.encode("utf-8", "replace"))
        if len(word) <= self.KEPT_CHARS and len(self) < self.KEPT_WORDS:
            self[word] = tokens
        return tokens

    def merged(self, word: bytes) -> int:
        """Symbols that are left when no adjacent pair has a rank."""
        ids, ranks = [self.symbols[b] for b in word], self.ranks
        size = len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            found = ranks.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, found[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, joined, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= size or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            merges += 1
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                found = ranks.get((joined, ids[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], joined, ids[k]))
            h = before[i]
            if h >= 0:
                found = ranks.get((ids[h], joined))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], ids[h], joined))
        return size - merges

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special string inside it counts as one."""
        if not text:
            return 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.count(part) for part in parts)
        return sum(map(self.__getitem__, self.words(text)))


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of the texts by a byte-level vocabulary of ``public_tokenizers`` (its file name)."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers

        merger = PairMerger(public_tokenizers.path(vocabulary))
        for texts in batches:
            yield pd.Series([merger.count(text) for text in texts], dtype="int64")

    return counted(text)


def with_token_counts(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Columns of these names in ``docs`` are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": token_count(whole, vocabulary)}).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
