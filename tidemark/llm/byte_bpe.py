"""Byte-level BPE by replaying the merges over all words that a task holds.

A task takes texts up to PART letters, splits them, and lays the words it has not met end to end, BLOCK letters or so
at a time, as one linked list of symbols. An inverted index has, for each merge rank, the places where a pair of neighbours makes that token. Ranks are
taken from the lowest up; every occurrence of a rank in the whole part is merged, and only the pairs to its left and
right are looked up anew and filed under their ranks. So the work is in proportion to the merges made, for one word of
a megabyte as for a million short ones.

The same words in other tasks are merged there again: a word is merged once a task, which costs less than to shuffle
all places of all words.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words, and letters in them, that a task remembers; letters of text that it splits at a time.
REMEMBER, REMEMBER_LETTERS = 400_000, 8 << 20
PART = 1 << 20
#: Letters of words that are merged at once.
BLOCK = 1 << 19
END = -1


class Ranks:
    """The tokens of a rank file: a token's id is its rank, and two neighbours merge if their bytes make a token."""

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank
        self.token: list[bytes] = [b""] * (max(self.rank.values(), default=-1) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.pair = np.array([self.rank.get(bytes([a, b]), END) for a in range(256) for b in range(256)], np.int32)
        length = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.starts = np.concatenate([[0], np.cumsum(length)])
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one after the other, and their number in each: all merges in the order of their ranks."""
        rank, token = self.rank.get, self.token
        length = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(words)), length)
        place = np.arange(len(letters)) + word + 1  # an END stands before, between and behind the words
        start = np.full(len(letters) + len(words) + 1, END, np.int32)
        start[place] = self.byte[letters]
        size = len(start)
        symbol, ahead, behind = (array("i", x.astype(np.int32).tobytes()) for x in (start, np.arange(1, size + 1), np.arange(-1, size - 1)))
        ends = np.flatnonzero(start == END).tolist()

        pair = np.where(word[1:] == word[:-1], self.pair[letters[:-1] * 256 + letters[1:]], END)
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        heap, begin = np.unique(pair[at], return_index=True)
        heap = heap.tolist()
        index = {r: p.tolist() for r, p in zip(heap, np.split(place[at], begin[1:]), strict=True)} if heap else {}

        while heap:
            now = heappop(heap)
            want, waiting, until = token[now], [], 0
            for at in sorted(index.pop(now)):
                a, right = symbol[at], ahead[at]
                b = symbol[right]
                # the pair may have gone with an earlier merge
                if a < 0 or b < 0 or token[a] + token[b] != want:
                    continue
                if at < until:
                    waiting.append(at)
                    continue
                after, left = ahead[right], behind[at]
                symbol[at], symbol[right] = now, END
                ahead[at], behind[after] = after, at
                a, b = symbol[left], symbol[after]
                for near, made in ((left, rank(token[a] + want) if a >= 0 else None), (at, rank(want + token[b]) if b >= 0 else None)):
                    if made is not None:
                        if made in index:
                            index[made].append(near)
                        else:
                            index[made] = [near]
                            heappush(heap, made)
                        if made < now:  # an earlier merge has become possible: the rest of this word waits for it
                            until = ends[bisect_right(ends, at)]
            if waiting:
                index[now] = waiting
                heappush(heap, now)

        found = np.frombuffer(symbol, np.int32)[place]
        alive = found >= 0
        count = np.bincount(word[alive], minlength=len(words))
        # a token that the merges cannot reach is still one token where it is a whole word
        for k in np.flatnonzero(count > 1).tolist():
            if words[k] in self.rank:
                first = int(length[:k].sum())
                found[first], alive[first : first + len(words[k])], count[k] = self.rank[words[k]], False, 1
                alive[first] = True
        return found[alive], count

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens; ids that are none have no bytes."""
        return self.bytes[ragged(self.starts, ids[(ids >= 0) & (ids < len(self.token))])].tobytes()


def ragged(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of all items of some rows of a ragged array, whose row r is ``starts[r]`` to ``starts[r + 1]``."""
    size = starts[rows + 1] - starts[rows]
    return np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


@cache
def ranks(path: str) -> Ranks:
    return Ranks.read(path)


class Encoder:
    """Token ids of texts; remembers what it has merged, up to REMEMBER words and REMEMBER_LETTERS letters."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.split = ranks(path), regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        self.letters += sum(map(len, new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        ids, counts = [self.ids], [np.diff(self.starts)]
        block, size = [], 0
        for w in [*new, None]:
            if block and (w is None or size > BLOCK):
                found, count = self.ranks.replay(block)
                ids.append(found)
                counts.append(count)
                block, size = [], 0
            if w is not None:
                block.append(w.encode())
                size += len(block[-1])
        self.ids, self.starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Token ids of the texts and where each text's begin and end, for as many texts at a time as have PART letters."""
        group, size = [], 0
        for text in [*texts, None]:
            if group and (text is None or size > PART):
                self._learn(set(chain.from_iterable(group)))
                n = np.fromiter(map(len, group), np.int64, len(group))
                words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(group)), np.int64, int(n.sum()))
                ends = np.concatenate([[0], np.cumsum(self.starts[words + 1] - self.starts[words])])
                yield self.ids[ragged(self.starts, words)], ends[np.concatenate([[0], np.cumsum(n)])]
                group, size = [], 0
                if len(self.known) > REMEMBER or self.letters > REMEMBER_LETTERS:
                    self._forget()
            if text is not None:
                group.append(self.split.findall(text))
                size += len(text)


def _encode(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(public_tokenizers.path(vocabulary), pattern)
        for batch in batches:
            at = 0
            for ids, ends in encoder.encode([t or "" for t in batch.column("text").to_pylist()]):
                rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(rows)), rows], names=["doc_id", "ids"])
                at += len(rows)

    return run


def _decode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks(public_tokenizers.path(vocabulary))
        for batch in batches:
            ids = batch.column("ids")
            for at in range(0, len(batch), 256):
                part = ids.slice(at, 256)
                flat, ends = part.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy())
                data = [known.decode(x) for x in np.split(flat, ends[:-1])] if len(part) else []
                rows = pa.array([d if v else None for d, v in zip(data, part.is_valid().to_pylist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 256), part, rows], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids``: the tokens of each row's whole text by the rank file, each match of the pattern for itself.

    No special tokens. Null text is empty and has no ids; repeated rows give repeated rows, an empty table none. One
    narrow pass, whatever the ids or copies.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(_encode(vocabulary, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes of the tokens. Null ids give null, ids that the file does not have no bytes."""
    rows = encoded.select(F.col("doc_id").cast("long"), F.filter(F.col("ids").cast("array<int>"), lambda i: i.isNotNull()).alias("ids"))
    return rows.mapInArrow(_decode(vocabulary), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each text, encoded and decoded again."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encode(docs, vocabulary), vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
