"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item that share a run of five tokens are a candidate pair. Running Karp-Rabin finds their
longest common runs of unmarked tokens, marks them as tiles on both sides, and goes on with shorter runs down to five.
The share of an item's tokens that tiles cover does not depend on the order of its passages in the text.

The benchmark is broadcast in blocks whose size is checked, one narrow pass over the texts for each, so texts are
never shuffled. Where there are several blocks, what one finds is written before the next is sent, and the block is
taken back, so a benchmark of any size takes the memory of one block (and time in proportion).

Tokens are runs of letters and digits; in scripts that write no spaces between words (Chinese characters, kana, Thai,
Lao, Khmer, Burmese, Tibetan) each letter is a token. An item of fewer than five tokens has no seed and matches nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Letters of scripts without spaces between words, as ranges of a character class.
UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"(?=\w)[{UNSPACED}]|[^\W_{UNSPACED}]+")
SHORTEST = 5
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
BASE = np.uint64(1_000_003)


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` ids, modulo 2^64."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = (ids + 2).astype(np.uint64)
    with np.errstate(over="ignore"):
        out, have, power = x.copy(), 1, BASE  # runs of `have` ids; doubled, then joined to the full size
        parts = []
        rest, at = size, 0
        while rest:
            if rest & 1:
                parts.append((at, have, out))
                at += have
            rest >>= 1
            if rest:
                out = out[: len(out) - have] * power + out[have:]
                have, power = have * 2, power * power
        total = np.zeros(n, np.uint64)
        for start, length, h in parts:
            scale = np.uint64(pow(int(BASE), length, 1 << 64))
            total = total * scale + h[start : start + n]
    return total


def _free_runs(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` unmarked places."""
    if len(free) < size:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(total[size:] - total[:-size] == size)


def tile(item: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Which tokens of ``item`` the tiles cover. Negative ids in ``text`` match nothing."""
    free_i, free_t = np.ones(len(item), bool), text >= 0
    size = max(shortest, min(20, len(item)))
    while True:
        starts_i, starts_t = _free_runs(free_i, size), _free_runs(free_t, size)
        if len(starts_i) and len(starts_t):
            h_t = _hashes(text, size)[starts_t]
            order = np.argsort(h_t, kind="stable")
            h_t, starts_t = h_t[order], starts_t[order]
            h_i = _hashes(item, size)[starts_i]
            low, high = np.searchsorted(h_t, h_i, "left"), np.searchsorted(h_t, h_i, "right")
            matches, longer = [], 0
            for i, a, b in zip(starts_i.tolist(), low.tolist(), high.tolist(), strict=True):
                for j in starts_t[a:b].tolist():
                    if i and j and free_i[i - 1] and free_t[j - 1] and item[i - 1] == text[j - 1]:
                        continue  # part of a match that began before
                    if not np.array_equal(item[i : i + size], text[j : j + size]):
                        continue
                    k = size
                    while i + k < len(item) and j + k < len(text) and free_i[i + k] and free_t[j + k] and item[i + k] == text[j + k]:
                        k += 1
                    if k > 2 * size:
                        longer = k
                        break
                    matches.append((-k, i, j))
                if longer:
                    break
            if longer:
                size = longer
                continue
            matches.sort()
            later = defaultdict(list)
            for k in sorted({-m[0] for m in matches}, reverse=True):
                later[k] = [m for m in matches if -m[0] == k]
            while later:
                k = max(later)
                for _, i, j in later.pop(k):
                    both = free_i[i : i + k] & free_t[j : j + k]
                    if both.all():
                        free_i[i : i + k] = free_t[j : j + k] = False
                    else:  # what is left of it, if long enough, is a match too
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], both.view(np.int8), [0]])))
                        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                            if b - a >= size:
                                later[b - a].append((-(b - a), i + a, j + a))
        if size == shortest or not free_i.any():
            return ~free_i
        size = max(shortest, size // 2)


class Benchmark:
    """One block of items: their token ids, and the items by the hash of each run of five tokens."""

    def __init__(self, rows: list[tuple[int, str]], shortest: int = SHORTEST):
        self.words: dict[str, int] = {}
        self.items, seeds, owners = [], [], []
        for i, text in rows:
            ids = np.array([self.words.setdefault(w, len(self.words)) for w in tokens(text)], np.int64)
            if len(ids) >= shortest:
                h = np.unique(_hashes(ids, shortest))
                seeds.append(h)
                owners.append(np.full(len(h), len(self.items)))
                self.items.append((i, ids))
        self.shortest = shortest
        seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seeds, self.owners = seed[order], (np.concatenate(owners)[order] if owners else np.zeros(0, np.int64))

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """Item id, covered tokens and tokens of every item that shares a seed with the text."""
        get = self.words.get
        words = tokens(text)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        h = _hashes(ids, self.shortest)
        low, high = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        near = np.zeros(len(ids) + 1, np.int64)  # only tokens in some seed can be in a tile
        np.add.at(near, hit, 1)
        np.add.at(near, hit + self.shortest, -1)
        near = np.cumsum(near)[:-1] > 0
        gap = near & ~np.concatenate([[False], near[:-1]])
        kept = np.insert(np.where(near, ids, -1)[near], np.flatnonzero(gap[near]), -1)
        found = np.unique(np.concatenate([self.owners[low[i] : high[i]] for i in hit.tolist()]))
        return [(self.items[k][0], int(tile(self.items[k][1], kept, self.shortest).sum()), len(self.items[k][1])) for k in found.tolist()]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in blocks of about ``block_bytes`` of text, one at a time, and whether it is the last."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // block_bytes))
    for k in range(count):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()], k + 1 == count


def _pairs(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Benchmark = shared.value
        for batch in batches:
            ids, found = batch.column("doc_id").to_pylist(), []
            for at in range(0, len(ids), 256):
                for d, text in zip(ids[at : at + 256], batch.column("text").slice(at, 256).to_pylist(), strict=True):
                    found += [(d, i, c, n) for i, c, n in block.matches(text) if c >= coverage * n]
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "covered", "item_tokens"])

    return run


def _clean(shared, coverage: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Benchmark = shared.value
        for batch in batches:
            column = batch.column(text)
            keep = [not any(c >= coverage * n for _, c, n in block.matches(t)) for at in range(0, len(column), 256) for t in column.slice(at, 256).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, covered, item_tokens, coverage`` for every text and item whose tiles cover at least ``coverage``.

    Tokens are runs of letters and digits, lower-cased. Items of fewer than five tokens, and null ones, match nothing;
    null texts are empty; repeated items count once, repeated rows of ``docs`` give repeated rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kinds = "doc_id long, item_id long, covered long, item_tokens long"
    parts = _by_block(benchmark, block_bytes, lambda shared, _: texts.mapInArrow(_pairs(shared, coverage), kinds))
    return reduce(DataFrame.unionByName, parts).withColumn("coverage", F.col("covered") / F.col("item_tokens"))


def _by_block(benchmark: DataFrame, block_bytes: int, work: Callable) -> list[DataFrame]:
    """``work`` of each broadcast block and the block's rows before it. Of several blocks, only one is held at a time, and its rows are written."""
    out = []
    for rows, last in _blocks(benchmark, block_bytes):
        shared = benchmark.sparkSession.sparkContext.broadcast(Benchmark(rows))
        found = work(shared, out[-1] if out else None)
        if out or not last:
            found = materialise(found)
            shared.destroy()
        out.append(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows and columns of ``docs`` that no item's tiles cover to ``coverage``.

    Null and empty texts, and all texts if there is no item, stay; repeated rows stay or go together. Columns may have
    any names. An empty table gives no rows.
    """
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = names[docs.columns.index("text")]
    left = _by_block(benchmark, block_bytes, lambda shared, before: (rows if before is None else before).mapInArrow(_clean(shared, coverage, at), rows.schema))
    return left[-1].toDF(*docs.columns)
