"""Alignment of two tokenizers' tokens over whole texts, and how often each pair of tokens ends together.

Method: exact-text deduplication. Texts are shuffled by their full text and counted; each distinct text is encoded by both
tokenizers and aligned once. The counts of its token pairs are weighed by the number of its copies, and its measures are joined
back to the documents by the text's SHA-256, a key that Spark splits where a text has very many copies.

Tokens are compared as bytes: the text with one space before it, as the byte-level vocabulary (A) sees it and as the piece
vocabulary (B) makes it. Offsets where a token of A and one of B both end cut the tokens into groups; the two tokens that end
there are a link. A pair's count is the number of its links over all documents.

Distinct texts travel in blocks: one row holds up to ``BLOCK`` tokens (one text at least), the block's distinct pairs, and its
texts' links as places in that list. Only a block's distinct pairs are joined with the corpus-wide counts, so the shuffle is far
smaller than the links. Blocks are written to the shared folder once; a lost executor costs the block it was making.

Null and empty texts, and texts whose tokens do not spell them in both vocabularies (white space that the piece vocabulary
changes, its own space sign inside a text), have no tokens: zeros, and an empty ``groups_sha256``. Texts are never cut; a very
long one is a block of its own. Every row is kept, repeated rows and null ids too. Ties for a B token's highest count all count.
An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectus.llm.common import stored
from prospectus.llm.token_counts import byte_letters

#: Tokens (of A) after which a block is closed.
BLOCK = 1_000_000


@dataclass
class Alignment:
    """Tokens of one text by both vocabularies, and the places in both lists of the tokens that end a group."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    def groups(self, a_written: np.ndarray, b_written: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, from the tables of ``Aligner.written``."""
        a_last, b_last = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        a_last[self.a_ends], b_last[self.b_ends] = 1, 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        out[np.arange(len(self.a)) + np.concatenate(([0], self.b_ends + 1))[a_group]] = a_written[2 * self.a + a_last]
        out[np.arange(len(self.b)) + (self.a_ends + 1)[b_group]] = b_written[2 * self.b + b_last]
        return b"".join(out.tolist())[:-1]


class Aligner:
    """Encodes texts by two vocabularies of ``public_tokenizers`` and aligns their tokens."""

    def __init__(self, a_vocabulary: str, b_vocabulary: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        path = public_tokenizers.path(a_vocabulary)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.fast = fast_reader(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        of_letter = {letter: byte for byte, letter in byte_letters().items()}
        own = {i: bytes(of_letter[c] for c in word) for word, i in content["model"]["vocab"].items() if all(c in of_letter for c in word)}
        size = max(self.library.get_vocab_size(), max(own) + 1)
        self.a_bytes = np.array([own.get(i, b"") for i in range(size)], dtype=object)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_vocabulary))
        ids = range(self.pieces.vocab_size())
        spelled = [bytes([int(self.pieces.id_to_piece(i)[1:-1], 16)]) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.b_bytes = np.array(spelled, dtype=object)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in words], dtype=np.int64) for words in (self.a_bytes, self.b_bytes))

        self.a_written, self.b_written = self.written(len(self.a_bytes), b"|"), self.written(len(self.b_bytes), b";")

    @staticmethod
    def written(size: int, last: bytes) -> np.ndarray:
        """Every id in decimals, with a comma (at 2 x id) and with the sign that follows a group's last token (at 2 x id + 1)."""
        return np.array([b"%d%s" % (i, sign) for i in range(size) for sign in (b",", last)], dtype=object)

    def encoded(self, text: str) -> list[int]:
        """Ids by A; special strings are plain text."""
        try:
            return self.fast(text)
        except ValueError:
            return self.library.encode(text, add_special_tokens=False).ids

    def aligned(self, text: str | None) -> Alignment | None:
        """None where the text has no tokens by the rules of the module."""
        if not text:
            return None
        whole = " " + text
        spelled = whole.encode("utf-8", "replace")
        a, b = np.array(self.encoded(whole), dtype=np.int64), np.array(self.pieces.encode(text), dtype=np.int64)
        if b"".join(self.a_bytes[a]) != spelled or b"".join(self.b_bytes[b]) != spelled:
            return None
        _, a_ends, b_ends = np.intersect1d(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), assume_unique=True, return_indices=True)
        return Alignment(a, b, a_ends, b_ends)

    def pairs(self, found: Alignment) -> np.ndarray:
        """Every link as one number, by B's token first."""
        return found.b[found.b_ends] * len(self.a_bytes) + found.a[found.a_ends]


def fast_reader(path: str):
    """The same ids from the rank file of the same vocabulary where there is one, else from the library."""
    import base64
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranked = os.path.splitext(path)[0] + ".tiktoken"
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        split = json.load(file).get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or not os.path.exists(ranked):
        return lambda text: library.encode(text, add_special_tokens=False).ids
    with open(ranked, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: fast.encode(text, disallowed_special=())  # raises ValueError where its stack is too small


#: One row a block; the texts' columns are lists of equal length, and ``links`` holds the texts' links one after the other.
BLOCKS = (
    "block string, keys array<string>, n_a array<long>, n_b array<long>, n_links array<long>, groups_sha256 array<string>, "
    "links binary, pairs array<long>, weights array<long>"
)


def aligned_blocks(texts: DataFrame, a_vocabulary: str, b_vocabulary: str, block: int = BLOCK) -> DataFrame:
    """Blocks of ``BLOCKS`` from distinct ``text`` with their ``copies`` and ``key``."""
    names = [part.split()[0] for part in BLOCKS.split(", ")]
    kinds = [pa.string(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), pa.binary(), *[pa.list_(pa.int64())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_vocabulary, b_vocabulary)
        rows, links, copies, used = [], [], [], 0

        def closed() -> pa.RecordBatch:
            pairs, places = np.unique(np.concatenate(links), return_inverse=True)
            sizes = [len(x) for x in links]
            weights = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(weights, places, np.repeat(np.array(copies, dtype=np.int64), sizes))
            keys, n_a, n_b, hashes = (list(x) for x in zip(*rows, strict=True))
            values = [keys[0], keys, n_a, n_b, sizes, hashes, places.astype("<u4").tobytes(), pairs, weights]
            return pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for text, key, n in zip(*(batch.column(name).to_pylist() for name in ("text", "key", "copies")), strict=True):
                found = aligner.aligned(text)
                if found is None:
                    continue
                rows.append((key, len(found.a), len(found.b), hashlib.sha256(found.groups(aligner.a_written, aligner.b_written)).hexdigest()))
                links.append(aligner.pairs(found))
                copies.append(n)
                used += len(found.a)
                if used >= block:
                    yield closed()
                    rows, links, copies, used = [], [], [], 0
        if rows:
            yield closed()

    return texts.select("text", "key", "copies").mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Every pair's links over the corpus (``links``), as ``pair`` = B's id x ``A_SIZE`` + A's id."""
    rows = blocks.select(F.explode(F.arrays_zip("pairs", "weights")).alias("x")).select("x.*")
    return rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("weights").alias("links"))


def measures(blocks: DataFrame, counts: DataFrame, a_size: int) -> DataFrame:
    """One row a distinct text: ``key``, its counts, and what its links sum up to by ``counts``."""
    b_id = F.floor(F.col("pair") / a_size)
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("links").alias("highest"))
    known = counts.withColumn("b", b_id).join(highest, "b").select("pair", "links", (F.col("links") == F.col("highest")).alias("best"))
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair")).join(known, "pair")
    entry = F.sort_array(F.collect_list(F.struct("place", "links", "best")))
    answers = asked.groupBy("block").agg(entry.alias("entries"))
    answers = answers.select(F.col("block").alias("of"), F.col("entries.links").alias("pair_links"), F.col("entries.best").alias("pair_best"))
    whole = blocks.drop("pairs", "weights").join(answers, F.col("block") == F.col("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda name: batch.column(name)[i]  # noqa: B023, E731
                places = np.frombuffer(value("links").as_py(), dtype="<u4")
                links, best = (value(name).values.to_numpy(zero_copy_only=False) for name in ("pair_links", "pair_best"))
                sizes = value("n_links").values.to_numpy()
                ends = np.cumsum(sizes)
                sums = (np.diff(np.concatenate(([0], np.cumsum(x[places].astype(np.int64))))[np.concatenate(([0], ends))]) for x in (links, best))
                count_sum, n_best = sums
                own = {name: value(name).values for name in ("keys", "n_a", "n_b", "n_links", "groups_sha256")}
                yield pa.RecordBatch.from_pydict(own | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)})

    return whole.mapInArrow(run, "keys string, n_a long, n_b long, n_links long, groups_sha256 string, n_best long, count_sum long").withColumnRenamed("keys", "key")


def aligned_documents(docs: DataFrame, a_vocabulary: str = "byte_bpe_50k.json", b_vocabulary: str = "piece_bpe_32k.model", block: int = BLOCK) -> DataFrame:
    """``doc_id`` and the measures of its text: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256``, a row for every row of ``docs``."""
    import public_tokenizers
    from tokenizers import Tokenizer

    a_size = Tokenizer.from_file(public_tokenizers.path(a_vocabulary)).get_vocab_size()
    digest = F.sha2(F.col("text"), 256)
    texts = docs.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))
    blocks = stored(aligned_blocks(texts.withColumn("key", digest), a_vocabulary, b_vocabulary, block))
    found = stored(measures(blocks, stored(pair_counts(blocks)), a_size))
    rows = docs.select("doc_id", digest.alias("key")).join(found, "key", "left")
    number = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    return rows.select(
        "doc_id", number("n_a"), number("n_b"), number("n_links").alias("n_groups"), number("n_links"), number("n_best"), number("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )
