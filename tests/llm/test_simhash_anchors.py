import random

import xxhash
from pyspark.sql import functions as F

import pytest

from tidemark.llm import common
from tidemark.llm.simhash_anchors import NARROW, WIDE, keep_one, links, near_duplicates

SCHEMA = "doc_id long, text string, fp string, component int"


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str), len({find(i) for i in range(len(rows))})


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = sorted((tuple(r)[:3] for r in near_duplicates(docs).collect()), key=str)
    want, groups = brute(rows)
    assert got == want
    left = keep_one(docs)
    assert left.columns == docs.columns and left.count() == groups
    return docs


def test_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice([60, 300]))]
        for _ in range(r.choice([1, 5, 12])):
            t = list(base)
            for _ in range(r.choice([0, 1, 2])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(None, None), (900, ""), (901, " \n"), (902, "one"), (902, "one"), (902, "ONE two"), (None, "zz yy"), (None, "zz yy"), (903, "long word " * 9000)]
    r.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize(("layout", "crowd"), [(NARROW, 4096), (NARROW, 2), (WIDE, 4096), (WIDE, 1)])
def test_links_are_all_pairs_in_reach(spark, layout, crowd):
    r = random.Random(1)
    fps = set()
    for _ in range(25):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            y = x
            for b in r.sample(range(64), r.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    got = {tuple(x) for x in links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, layout, crowd).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).collect() == [] and keep_one(docs).collect() == []


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(x) for x in docs.collect()]
    check(spark, rows)
    assert keep_one(docs).agg(F.min("doc_id")).first()[0] == 0


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(200)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(30):
        t = list(base)
        t[r.randrange(len(t))] = r.choice(words)
        rows.append((40 + i, " ".join(t)))
    rows += [(100 + i, " ".join(r.choice(words) for _ in range(60))) for i in range(20)]
    check(spark, rows)


def test_clashing_names(spark):
    rows = [(i, "one two three four five six" if i < 3 else f"text {i} is not like the others", "a", i, "b", i, "c", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_mark string, kept_id int, kept_same string, same int, mark string, kept_0 int")
    assert sorted(keep_one(docs).collect()) == sorted(x for x in docs.collect() if x.doc_id in (0, 3, 4, 5))


@pytest.mark.parametrize("crowd", [4096, 1])
def test_copies_of_fingerprints_are_not_sent(spark, crowd):
    """However few fingerprints there are, what they are replicated to meets by a shuffle."""
    fps = common.materialise(spark.range(40).select((F.col("id") % 20).alias("fp")).distinct())
    found = links(fps, 4, NARROW, crowd)
    assert "SortMergeJoin [anchor" in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in found.collect()} == {(a, b) for a in range(20) for b in range(20) if a < b and (a ^ b).bit_count() <= 4}
