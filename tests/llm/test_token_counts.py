import random
import time

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.token_counts import VOCABULARY, Counter, count_tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
ODD = [
    "", " ", "\n\n  x", "aaaaaaaaa aaaa", "don't we'll", "é ß 漢字 🙂🙂", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "1234567890½²", "\x1c\x1d\x85  x", "x" * 5000,
    "the quick brown fox " * 3000, "\t\ttab\x00nul", "...!!!???", "​﻿zero",
]


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts():
    assert Counter(public_tokenizers.path(VOCABULARY)).counts(ODD) == library(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=8))
def test_any_text(texts):
    assert Counter(public_tokenizers.path(VOCABULARY)).counts(texts) == library(texts)


def test_long_pre_tokens():
    """Letters without a space, as in base64 or scripts that write none: merged, and in reasonable time."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF") for _ in range(n)) for n in (1, 2, 3000, 80_000)] + ["ab" * 40_000, "a" * 80_001]
    start = time.perf_counter()
    assert Counter(public_tokenizers.path(VOCABULARY)).counts(words) == library(words)
    assert time.perf_counter() - start < 30


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in count_tokens(docs).collect()}
    rows = docs.collect()
    want = library([r.text for r in rows])
    assert [got[r.doc_id].n_tokens for r in rows] == want
    assert all(got[r.doc_id].n_bytes == len(r.text.encode()) and got[r.doc_id].over_limit == (n > 1024) for r, n in zip(rows, want, strict=True))


def test_nulls_repeats_and_none(spark):
    schema = "doc_id long, text string, n_tokens string"
    rows = [(None, "a b", "x"), (1, None, None), (1, None, None), (2, "", "y"), (2, "a b", "")]
    got = sorted((tuple(r) for r in count_tokens(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False), (2, 3, 2, False)], key=str)
    assert count_tokens(spark.createDataFrame([], schema)).collect() == []
