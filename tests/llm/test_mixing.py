import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix, mixed_documents

DOCS = "doc_id long, text string, source string, epoch int, mark string"


def facts(rows, size):
    """Tokens taken of each source, how often each document was taken, and its epochs."""
    used, epochs = Counter(), defaultdict(list)
    for r in rows:
        used[r.source] += size[r.doc_id]
        epochs[r.doc_id].append(r.epoch)
    return used, epochs


def solve(shares, target):
    low, high = 0.0, 64.0
    for _ in range(200):
        a = (low + high) / 2
        w = [s**a for s in shares]
        w = [x / sum(w) for x in w]
        low, high = (a, high) if -sum(x * math.log(x) for x in w if x > 0) > target else (low, a)
    return a, w


@pytest.mark.parametrize(("block_docs", "budget", "target"), [(16, None, None), (4096, 30_000, 0.5), (7, 900, 1.05)])
def test_quotas_and_permutations(spark, block_docs, budget, target):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "abcd"[min(3, i % 9)], 1, "x") for i in range(900)]
    size = {r[0]: len(r[1].split()) for r in rows}
    total = Counter()
    for r in rows:
        total[r[2]] += size[r[0]]
    everything = sum(total.values())
    got = mix(spark.createDataFrame(rows, DOCS), budget, target, max_repeats=100, block_docs=block_docs).collect()
    names = sorted(total)
    shares = [total[s] / everything for s in names]
    own = -sum(s * math.log(s) for s in shares)
    _, want = solve(shares, (own + math.log(4)) / 2 if target is None else target)
    weight = {r.source: r.weight for r in got}
    used, epochs = facts(got, size)
    for s, w in zip(names, want, strict=True):
        quota = w * (budget or everything)
        if s in weight:
            assert weight[s] == pytest.approx(w, rel=1e-5)
        assert quota - 24 <= used[s] <= quota + 1
    for i, e in epochs.items():
        assert sorted(e) == list(range(len(e)))  # no pass is skipped or doubled
    for s in names:
        counts = {len(epochs.get(r[0], ())) for r in rows if r[2] == s}
        assert max(counts) - min(counts) <= 1
    again = mix(spark.createDataFrame(rows[::-1], DOCS).repartition(5), budget, target, max_repeats=100, block_docs=block_docs).collect()
    key = lambda rs: sorted((r.doc_id, r.epoch, r.stream_block, r.place) for r in rs)
    assert key(again) == key(got)


def test_repetition_limit(spark):
    rows = [(i, "a b c", "big" if i < 950 else "small", 1, "x") for i in range(1000)]
    got = mix(spark.createDataFrame(rows, DOCS), max_repeats=3.0, block_docs=10, target_entropy=math.log(2)).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    used = {r.source: r.n for r in got}
    assert 440 <= used["small"] <= 450


def test_odd_rows(spark):
    rows = [(1, "a b", None, 1, "x"), (1, "a b", None, 1, "x"), (None, "c", "", 1, "x"), (2, None, "s", 1, "x"), (3, "", "t", 1, "x"), (4, "d " * 50000, "u", 1, "x"), (5, "e f g", "u", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = mix(docs, budget=400_000, max_repeats=1e9).collect()
    assert {r.source for r in got} == {"", "u"} and all(0 <= r.stream_block < 64 for r in got)
    full = mixed_documents(docs, budget=400_000, max_repeats=1e9)
    assert full.columns == [*docs.columns, "mix_epoch", "mix_block", "mix_place"] and full.count() == len(got)
    assert mix(docs.limit(0)).collect() == [] and mixed_documents(docs.where("doc_id IN (2, 3)")).collect() == []


def test_stream_blocks_hold_the_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mix(docs, stream_blocks=8, block_docs=32)
    by = got.groupBy("stream_block").agg(F.sum("tokens").alias("n")).collect()
    assert len(by) == 8 and max(r.n for r in by) < 1.3 * min(r.n for r in by)


@pytest.mark.parametrize(("target", "limit"), [(0.05, 4.0), (1.5, 1.5), (2.3, 1.2)])
def test_limit_holds_at_every_exponent(spark, target, limit):
    """Eleven sources of equal texts; a low entropy wants almost all tokens from the largest."""
    rows = [(s * 100 + i, "a b c d e", f"s{s}", 1, "x") for s in range(11) for i in range(30 if s == 0 else 21)]
    got = mix(spark.createDataFrame(rows, DOCS), max_repeats=limit, target_entropy=target, block_docs=8).collect()
    size = Counter(r[2] for r in rows)
    used = Counter(r.source for r in got)
    assert max(Counter(r.doc_id for r in got).values()) <= math.ceil(limit)
    assert all(used[s] <= limit * size[s] for s in size)
    if target > 2:
        assert len(used) == 11


def test_many_sources_and_a_high_exponent(spark):
    rows = [(i, "a b", f"s{i % 500}", 1, "x") for i in range(500)] + [(1000 + i, "a b", "top", 1, "x") for i in range(2)]
    got = mix(spark.createDataFrame(rows, DOCS), max_repeats=1e9, target_entropy=0.001)
    assert {r.source for r in got.collect()} == {"top"}


def test_names_that_the_stage_adds(spark):
    rows = [(i, "a b c", "s", 7, "m", 8) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_epoch int, MIX_PLACE string, row int")
    got = mixed_documents(docs)
    assert got.columns == [*docs.columns, "mix_epoch_", "mix_block", "mix_place_"]
    assert got.where("mix_epoch = 7 AND MIX_PLACE = 'm' AND row = 8").count() == got.count() == 20
