import math
import random

import duckdb

from tidemark.llm import hard_negatives
from tidemark.llm.hard_negatives import mine, oracle, shifted_labels

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=100):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    asking = {}
    for i, lab, q in sorted(kept):
        if i % every == 0:
            asking.setdefault(i, (lab, q))
    out = []
    for a, (lab, q) in asking.items():
        scored = sorted((-sum(x * y for x, y in zip(q, w, strict=True)), i, other == lab) for i, other, w in kept if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            near = [x for x in scored if not x[2] and -80 * s <= -100 * x[0] <= -100 * s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(near)]
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in mine(df, **more).collect())


def test_table_and_sql(spark, sf):
    found = got(shifted_labels(spark.read.parquet(f"{sf}/embeddings.parquet")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert found == sorted(con.execute(oracle()).fetchall()) and len(found) > 100


def many(seed, n=400):
    """Few values, so that scores tie; a third of the rows are one vector of one label."""
    r = random.Random(seed)
    rows = [(i, r.randrange(4), [r.choice([-1.0, -0.5, 0.0, 0.3, 1.0]) for _ in range(6)]) for i in range(n)]
    return [(i, 1, [1.0] * 6) if i % 3 == 0 else (i, lab, v) for i, lab, v in rows]


def test_ties_and_hot_vector(spark):
    rows = many(1)
    assert got(spark.createDataFrame(rows, SCHEMA), every=20) == brute(rows, 20)


def test_blocks_of_anchors_and_rows(spark, monkeypatch):
    rows = many(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(hard_negatives, "ROWS", 37)
    assert got(df, every=10, block_bytes=4_000) == brute(rows, 10)


def test_nulls_odd_vectors_and_repeats(spark):
    rows = many(3, 200)
    rows += [(None, 1, [1.0] * 6), (1000, None, [1.0] * 6), (1100, 1, None), (1200, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1300, 1, [math.nan] * 6), (1400, 1, [math.inf] + [0.0] * 5)]
    rows += [(500, 2, [0.0] * 6), (40, 3, [0.9] * 6), (41, 3, [0.9] * 6), (41, 3, [0.9] * 6), (-100, 2, [-1.0] * 6)]
    assert got(spark.createDataFrame(rows, SCHEMA), every=20) == brute(rows, 20)
    # left out: other lengths than most have, and values whose scores no long can hold
    more = [*rows, (60, 1, [1.0]), (80, 1, []), (90, 2, [1e300] + [0.0] * 5)]
    assert got(spark.createDataFrame([(*r, "x") for r in more], SCHEMA + ", rank string"), every=20) == brute(rows, 20)


def test_large_whole_numbers(spark):
    """Scores past 53 bits are exact."""
    r = random.Random(5)
    rows = [(i, i % 2, [float(r.randrange(10**5, 10**6)) for _ in range(3)]) for i in range(60)]
    assert got(spark.createDataFrame(rows, SCHEMA), every=10) == brute(rows, 10)


def test_none(spark):
    assert mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mine(spark.createDataFrame([(1, 1, [1.0])], SCHEMA)).collect() == []
    assert mine(spark.createDataFrame([(100, 1, [1.0])], SCHEMA)).collect() == []
