from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prospectus.llm.token_counts import PairMerger, with_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, MERGER = Tokenizer.from_file(PATH), PairMerger(PATH)


def of_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_counts_are_the_librarys(documents, awkward):
    docs = documents(awkward, extra=("n_tokens", "over_limit", "tokens"))
    found = with_token_counts(docs).collect()
    assert len(found) == len(awkward)
    for row in found:
        text = row["text"]
        assert (row["n_bytes"], row["n_tokens"]) == (len((text or "").encode()), of_library(text))
        assert row["over_limit"] == (row["n_tokens"] > 1024)
        assert row["tokens"] == "x"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=("Cs",)), st.sampled_from(" \n\t'  \x1cste<|>🙂")), max_size=80))
def test_any_text(text):
    assert MERGER.count(text) == of_library(text)


def test_special_strings_inside_a_text():
    text = "a<|endoftext|><|endoftext|> b <|endoftext|>"
    assert MERGER.count(text) == of_library(text)


def test_words_that_are_not_kept():
    word = "abcdefgh" * 5_000
    assert MERGER.count(word) == of_library(word)
    assert word not in MERGER


def test_empty_table(documents):
    assert with_token_counts(documents([])).count() == 0
