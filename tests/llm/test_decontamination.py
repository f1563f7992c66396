import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.decontamination import Benchmark, _hashes, contaminated, drop_contaminated, tile, tokens

DOCS = "doc_id long, text string, item_id string, covered int"
ITEM = "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi, rho sigma tau upsilon phi chi psi omega!"


def brute(item, text, shortest=5):
    """Greedy tiling by comparing every pair of places again and again."""
    free_i, free_t = [True] * len(item), [x >= 0 for x in text]
    while True:
        best, found = shortest, []
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and free_i[i + k] and free_t[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return [not f for f in free_i]
        for i, j in found:
            if all(free_i[i : i + best]) and all(free_t[j : j + best]):
                free_i[i : i + best] = free_t[j : j + best] = [False] * best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=5, max_size=40), st.lists(st.integers(-1, 2), max_size=70))
def test_tiles_of_small_alphabets(item, text):
    assert tile(np.array(item), np.array(text, dtype=np.int64)).tolist() == brute(item, text)


def test_hashes_tell_runs_apart():
    rng = np.random.default_rng(0)
    ids = rng.integers(-1, 3, 3000)
    for size in (1, 5, 7, 20, 41):
        h = _hashes(ids, size)
        runs = [tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)]
        assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs)) == len(set(zip(h.tolist(), runs)))


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_odd_rows(spark, block):
    words = tokens(ITEM)
    half = len(words) // 2
    rows = [
        (1, "some words before " + ITEM.upper() + " and after"), (2, " ".join(words[half:]) + " unrelated filler here " + " ".join(words[:half])), (3, " ".join(words[:6]) + " other"), (4, None), (4, None), (5, ""),
        (None, ITEM), (6, ITEM), (6, ITEM), (7, (ITEM + " ") * 2000), (8, " ".join(reversed(words))), (9, "x" * 100000),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "too short here"), (4, "entirely different words that never stand in any other text at all")], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id, r.coverage) for r in contaminated(docs, bench, block_bytes=block).collect()))
    assert got == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (6, 1, 1.0), (6, 1, 1.0), (7, 1, 1.0)]
    kept = drop_contaminated(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 4, 5, 8, 9]
    assert contaminated(docs.limit(0), bench).collect() == [] and drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_table(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: tokens(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        text = tokens(r.text)
        grams = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for k, t in items.items():
            if grams & {tuple(t[i : i + 5]) for i in range(len(t) - 4)}:
                number = {w: n for n, w in enumerate(set(t))}
                n = sum(brute([number[w] for w in t], [number.get(w, -1) for w in text]))
                if n >= 0.5 * len(t):
                    want.add((r.doc_id, k, n))
    got = {(r.doc_id, r.item_id, r.covered) for r in contaminated(docs, bench).collect()}
    assert got == want and got


def test_unspaced_scripts():
    assert tokens("我们test的x_1 ภาษา") == ["我", "们", "test", "的", "x", "1", *"ภาษา"]
    item = Benchmark([(1, "今天天气很好我们去公园")])
    assert [x[0] for x in item.matches("他说今天天气很好我们去公园吧")] == [1]
