import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe
from tidemark.llm.byte_bpe import VOCABULARY, Encoder, Ranks, decode, encode, ranks, round_trip

PATH = public_tokenizers.path(VOCABULARY)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(PATH).rank, special_tokens={})
ODD = [
    "", " ", "\n\n  x", "aaaaaaaaa aaaa", "don't we'll", "é ß 漢字 🙂🙂", "<|endoftext|>", "1234567890½²", "\x1c\x1d\x85  x", "x" * 5000, "the quick brown fox " * 3000,
    "\t\ttab\x00nul", "...!!!???", "​﻿zero", "   　a", "ab" * 40_000, "a" * 80_001,
]


def ids(texts, encoder=None):
    return [found[a:b].tolist() for found, ends in (encoder or Encoder(PATH)).encode(texts) for a, b in zip(ends, ends[1:], strict=False)]


def replayed(of, words):
    found, count = of.replay([w.encode() for w in words])
    return [x.tolist() for x in np.split(found, np.cumsum(count)[:-1])]


def test_odd_texts():
    assert ids(ODD) == [LIBRARY.encode_ordinary(t) for t in ODD]
    assert [ranks(PATH).decode(np.array(i, np.int32)).decode() for i in ids(ODD)] == ODD


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=8))
def test_any_text(texts):
    assert ids(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("seed", range(60))
def test_any_ranks(seed):
    """Rank files in which a merge makes an earlier one possible, tokens overlap, or no merge reaches a token."""
    r = random.Random(seed)
    more = list({bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(r.randint(1, 25))})
    r.shuffle(more)
    own = Ranks({t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *more])})
    library = tiktoken.Encoding(f"own{seed}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(80)]
    assert replayed(own, words) == [library.encode_ordinary(w) for w in words]


def test_small_blocks_and_memory(monkeypatch):
    texts = [f"word{i} and {i * 7919} more" for i in range(300)] * 2
    monkeypatch.setattr(byte_bpe, "PART", 50)
    monkeypatch.setattr(byte_bpe, "BLOCK", 7)
    monkeypatch.setattr(byte_bpe, "REMEMBER", 20)
    assert ids(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in round_trip(docs).collect()}
    for r in docs.collect():
        want = LIBRARY.encode_ordinary(r.text)
        assert got.pop(r.doc_id) == (r.doc_id, len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert not got


def test_nulls_repeats_and_none(spark):
    schema = "doc_id long, text string, ids string, decoded int"
    rows = [(None, "a b", "x", 1), (1, None, None, 2), (1, None, None, 2), (2, "", "y", 3), (2, "a b", "", 4)]
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in decode(encode(spark.createDataFrame(rows, schema))).collect()), key=str)
    ab = LIBRARY.encode_ordinary("a b")
    assert got == sorted([(None, ab, b"a b"), (1, [], b""), (1, [], b""), (2, [], b""), (2, ab, b"a b")], key=str)
    assert round_trip(spark.createDataFrame([], schema)).collect() == []


def test_decode_of_odd_ids(spark):
    rows = [(1, [64, None, 65]), (2, None), (3, [-1, 50_256, 64, 10**9]), (4, [])]
    got = {r.doc_id: r.decoded for r in decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    one = ranks(PATH).token[64]
    assert {k: v if v is None else bytes(v) for k, v in got.items()} == {1: one + ranks(PATH).token[65], 2: None, 3: one, 4: b""}
