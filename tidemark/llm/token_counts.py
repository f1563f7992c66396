"""Byte-level BPE token counts by rank-synchronous merging of ragged numpy arrays.

A task collects the distinct pre-tokens of a batch that it has not met, holds them as one flat array of symbols with
row offsets, and repeats: look up the rank of every adjacent pair, take each pre-token's lowest rank, and merge all
occurrences of that pair from the left, in every pre-token at once. What survives is the token count of a pre-token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lm_scoring import Lookup

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens, and letters in them, that a task remembers.
REMEMBER, REMEMBER_LETTERS = 1_000_000, 32 << 20
PART = 1 << 20
#: Fixed value: the pre-token pattern of byte-level BPE, as the vocabulary's pre-tokenizer applies it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The merge table of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.size = 1 << max(vocab.values()).bit_length()
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.rank = Lookup(keys, np.arange(len(pairs), dtype=float))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(SPLIT)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word after all merges.

        Ranks of adjacent pairs are kept from round to round; only those beside a merge are looked up again.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        row = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        rank = self._ranks(symbols, row, np.arange(len(symbols)))
        none = len(self.made)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            low = np.minimum.reduceat(rank, starts)
            open_rows = low < none
            size = np.diff(np.append(starts, len(row)))
            if not open_rows.all():
                out[row[starts[~open_rows]]] = size[~open_rows]
                stay = np.repeat(open_rows, size)
                symbols, row, rank = symbols[stay], row[stay], rank[stay]
                low, size = low[open_rows], size[open_rows]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            # in a run of overlapping occurrences, every other one from the left is merged
            begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
            merge = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbols[merge] = self.made[rank[merge]]
            gone = np.ones(len(symbols), bool)
            gone[merge + 1] = False
            symbols, row, rank = symbols[gone], row[gone], rank[gone]
            new = merge - np.arange(len(merge))  # where the merged symbols stand now
            near = np.unique(np.concatenate([new, new[new > 0] - 1]))
            rank[near] = self._ranks(symbols, row, near)
        return out

    def _ranks(self, symbols: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the places ``at``; the number of merges where there is none in a row."""
        out = np.full(len(at), len(self.made), np.int64)
        inside = at < len(symbols) - 1
        inside[inside] = row[at[inside]] == row[at[inside] + 1]
        a = at[inside]
        rank, hit = self.rank.find(symbols[a] * self.size + symbols[a + 1])
        out[inside] = np.where(hit, rank, len(self.made)).astype(np.int64)
        return out


@cache
def merger(path: str) -> Merger:
    return Merger(path)


class Counter:
    """Token counts of texts; remembers what it has counted, up to REMEMBER pre-tokens and REMEMBER_LETTERS letters."""

    def __init__(self, path: str):
        self.bpe = merger(path)
        self.known: dict[str, int] = {}
        self.letters = 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        self.letters += sum(map(len, new))
        part: list[str] = []
        size = 0
        for w in [*new, None]:
            if part and (w is None or size > PART):
                self.known.update(zip(part, self.bpe.count([p.encode() for p in part]).tolist(), strict=True))
                part, size = [], 0
            if w is not None:
                part.append(w)
                size += len(w)

    def counts(self, texts: list[str]) -> list[int]:
        bpe, out, group, size = self.bpe, [], [], 0
        for text in [*texts, None]:
            if text is None or size > PART:
                self.learn({w for words, _ in group for w in words})
                get = self.known.__getitem__
                out += [extra + sum(map(get, words)) for words, extra in group]
                group, size = [], 0
                if len(self.known) > REMEMBER or self.letters > REMEMBER_LETTERS:
                    self.known.clear()
                    self.letters = 0
            if text is not None:
                pieces = bpe.special.split(text) if bpe.special else [text]
                words = bpe.split.findall(pieces[0]) if len(pieces) == 1 else [w for p in pieces for w in bpe.split.findall(p)]
                group.append((words, len(pieces) - 1))
                size += len(text)
        return out


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(public_tokenizers.path(vocabulary))
        for batch in batches:
            n = counter.counts([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, limit: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row: tokens of the whole text without added ones.

    A special token's string inside a text is that one token, as the library has it by default. Null text is empty
    and has no tokens. One narrow pass: no shuffle, whatever the ids or copies.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return docs.mapInArrow(_count(vocabulary), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
