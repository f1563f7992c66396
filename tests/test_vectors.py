"""Vector searches held against NumPy over all pairs, and their stated queries."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import vectors as X

SEARCHES = ("cosine_topk", "cosine_topk_by_direction", "lse_signal", "kernel_mixture", "anchor_classify", "tiered_map", "unanimous_topk", "neighbour_expectation", "anchors_by_model")


@pytest.mark.parametrize("name", SEARCHES)
def test_stated_queries(spark, sf, name):
    """Only ids that 50 divides ask (anchors: all), and their SQL agrees (tests/test_oracles.py)."""
    got = {r.q for r in plans.QUERIES[name](spark, sf).select("q").collect()}
    stated = {i for i in range(500) if name == "anchors_by_model" or i % 50 == 0}
    assert got and got <= stated and (got == stated or name in ("unanimous_topk", "tiered_map"))


def test_tiles_and_blocks_change_nothing(spark, monkeypatch):
    """Copies, a zero vector and small tiles: the same neighbours as over all pairs."""
    monkeypatch.setattr(X, "TILE", 40)
    monkeypatch.setattr(X, "MAX_BROADCAST_VECTORS", 70)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 8))
    v[20:90] = v[20]
    v[100] = 0
    data = [(i, v[i].tolist(), "UP" if i % 3 else "DOWN") for i in range(150)]
    pool = spark.createDataFrame(data, "id long, v array<double>, direction string").repartition(7)
    asked = pool.selectExpr("id AS q", "v AS qv")
    n = np.sqrt((v * v).sum(axis=1))
    for per in (None, "direction"):
        keys = ["q", per] if per else ["q"]
        got = {(r.q, per and r.direction, r.rank): r.id for r in X.top_similar(X.nearest(asked, pool, 4, per), keys, 4).collect()}
        want = {}
        for q in range(150):
            dot = (v[q] * v).sum(axis=1)
            sim = np.divide(dot, n[q] * n, out=np.zeros(150), where=n[q] * n > 0)
            for side in ("UP", "DOWN") if per else (None,):
                ids = [i for i in np.lexsort((np.arange(150), -sim)) if i != q and (side is None or data[i][2] == side)]
                want |= {(q, side, r + 1): i for r, i in enumerate(ids[:4])}
        assert got == want


def test_timed_search_sees_earlier_days_only(spark, monkeypatch):
    """Tiles along the day and several blocks of queries: the nearest of what was known before, a hot day included."""
    monkeypatch.setattr(X, "TILE", 40)
    monkeypatch.setattr(X, "MAX_BROADCAST_VECTORS", 60)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 6))
    v[50:90] = v[50]
    day = np.where(np.arange(200) % 3 == 0, 10, rng.integers(0, 30, 200)).tolist()
    date = lambda d: datetime.date(2024, 1, 1) + datetime.timedelta(d)
    data = [(i, v[i].tolist(), date(day[i]) if i != 7 else None, "x") for i in range(200)]
    pool = spark.createDataFrame(data, "id long, v array<double>, known date, more string").repartition(5)
    asked = pool.select(F.col("id").alias("q"), F.col("v").alias("qv"), F.col("known").alias("at"))
    got = {(r.q, r.rank): r.id for r in X.top_similar(X.nearest(asked, pool, 3, timed=True), ["q"], 3).collect()}
    want = {}
    for q in range(200):
        sim = (v[q] * v).sum(axis=1) / (np.linalg.norm(v[q]) * np.linalg.norm(v, axis=1))
        earlier = [i for i in np.lexsort((np.arange(200), -sim)) if day[i] < day[q] and 7 not in (i, q)]
        want |= {(q, r + 1): i for r, i in enumerate(earlier[:3])}
    assert got == want
    none = X.nearest(asked.limit(0), pool, 3, timed=True)
    assert none.count() == 0 and "known" in none.columns and X.nearest(asked, pool.limit(0), 3, timed=True).count() == 0


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """Three different vectors in 90 rows: three are asked with, three are compared; every row finds what comparing all finds."""
    asked, compared, best = [], spark.sparkContext.accumulator(0), X._best

    def counted(queries, *rest):
        asked.append(len(queries()[0]))
        run = best(queries, *rest)

        def seen(batches):
            held = list(batches)
            compared.add(sum(b.num_rows for b in held))
            return run(iter(held))

        return seen

    monkeypatch.setattr(X, "_best", counted)
    v = [[1.0, 0.0], [0.8, 0.6], [0.0, 2.0]]
    rows = [(i, v[0 if i == 4 else 1 + i % 2]) for i in range(90)] + [(90, [float("nan"), 1.0]), (91, [None, 1.0])]
    pool = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in X.top_similar(X.nearest(pool.selectExpr("id AS q", "v AS qv"), pool, 3), ["q"], 3).collect():
        got.setdefault(r.q, []).append(r.id)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {i: sorted((j for j in range(90) if j != i), key=lambda j: (-round(cos(rows[i][1], rows[j][1]), 12), j))[:3] for i in range(90)}
    assert got == want | {90: [0, 1, 2], 91: [0, 1, 2]}
    assert sum(asked) == 5 and compared.value == 5


def test_rough_products_lose_no_neighbour(spark, monkeypatch):
    """Similarities closer together than single precision tells apart, zero vectors, and fewer rows than neighbours."""
    monkeypatch.setattr(X, "FIRST", 8)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1, 12)) + 1e-6 * rng.normal(size=(300, 12))
    v[250:] = rng.normal(size=(50, 12))
    v[[3, 299]] = 0
    pool = spark.createDataFrame([(i, x.tolist(), "UP" if i < 298 else "DOWN") for i, x in enumerate(v)], "id long, v array<double>, direction string")
    got = {(r.q, r.direction, r.rank): r.id for r in X.top_similar(X.nearest(pool.selectExpr("id AS q", "v AS qv"), pool, 5, "direction"), ["q", "direction"], 5).collect()}
    n, want = np.sqrt((v * v).sum(axis=1)), {}
    for q in range(300):
        dot = (v[q] * v).sum(axis=1)
        sim = np.divide(dot, n[q] * n, out=np.zeros(300), where=n[q] * n > 0)
        for side, ids in (("UP", range(298)), ("DOWN", range(298, 300))):
            best = sorted((i for i in ids if i != q), key=lambda i: (-sim[i], i))[:5]
            want |= {(q, side, r + 1): i for r, i in enumerate(best)}
    assert got == want
