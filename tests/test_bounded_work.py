"""Work that must not gather a key's rows in one task, or all pairs in a shuffle."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from tidemark.operators import kernels as K
from tidemark.operators import research as S
from tidemark.operators import statistics as A
from tidemark.operators import vectors as X
from tidemark.plans import QUERIES

DAY = dt.date(2024, 1, 9)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_log_sum_exp_sorts_no_key(spark):
    rows = spark.createDataFrame([("a", 0.1), ("a", 0.1), ("a", 0.3), (None, 0.2), ("b", None)], "k string, x double")
    out = A.log_sum_exp(rows, ["k"], "x", 0.1)
    assert "Window" not in _plan(out)
    got = {r["k"]: r["lse"] for r in out.collect()}
    assert got["a"] == pytest.approx(3 + math.log(2 * math.exp(-2) + 1 + 1e-12)) and got[None] == pytest.approx(2 + math.log(1 + 1e-12)) and got["b"] is None


def test_prototype_stats_gathers_prices_once(spark, sf):
    assert _plan(QUERIES["prototype_stats"](spark, sf)).count("percentile(") == 1


def test_likely_gives_the_heaviest_prototypes(spark, monkeypatch):
    """A few rows for each query leave the tasks, in pieces and in blocks of pairs; they are those of comparing all."""
    monkeypatch.setattr(S, "PIECE_ROWS", 40)
    monkeypatch.setattr(S, "PAIRS", 100)
    draw = random.Random(3)
    vector = lambda: [draw.uniform(-1, 1) for _ in range(3)]
    asked = [(DAY, i, vector() if i else [0.0] * 3, draw.choice(["UP", None]), draw.choice("01")) for i in range(100)]
    pool = [(DAY, c, vector(), draw.choice(["UP", "DOWN", None]), draw.choice("01"), draw.uniform(0, 9), draw.uniform(0, 60)) for c in range(30)]

    def weight(q, p):
        dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
        size = math.sqrt(dot(q[2], q[2]) * dot(p[2], p[2]))
        same = q[3] is not None and q[3] == p[3] or q[4] == p[4]
        return math.exp(12 * (max(0.0, dot(q[2], p[2]) / size if size else 0.0) - 1)) * (0.45 + 0.3 * min(1, p[5] / 5) + 0.25 / (1 + p[6] / 30)) * (0.4 + 0.6 * same)

    a = spark.createDataFrame(asked, "as_of date, q long, qv array<double>, q_regime string, q_sector string")
    b = spark.createDataFrame(pool, "as_of date, cluster int, vector array<double>, regime string, sector string, decayed double, freshness double")
    wanted = {(q[1], p[1]) for q in asked for p in sorted(pool, key=lambda p: -weight(q, p))[:5]}
    assert {(r["q"], r["cluster"]) for r in S.likely(a, b, 5).collect()} == wanted


def test_prototype_scores_asks_with_the_stated_queries(spark, sf):
    asked = {r["q"] for r in QUERIES["prototype_scores"](spark, sf).select("q").distinct().collect()}
    assert asked and all(q % 50 == 0 for q in asked)


def test_a_search_task_holds_few_similarities():
    """Several copies of a chunk's similarities are held at once."""
    assert X.TILE * X.CHUNK * 8 <= 10e6


def test_distribution_ranks_only_what_is_likely(spark):
    """The windows of a distribution come after the pieces in which pairs are weighed, not after a join of all pairs."""
    a = spark.createDataFrame([], "as_of date, q long, qv array<double>, q_regime string, q_sector string")
    side = "struct<" + ", ".join(f"{c}: double" for c in ("mean", "mae", "mfe", "q10", "q50", "q90", "uncertainty", "p_target", "p_stop", "p_flat", "p_ambiguous", "p_no_trade", "p_up", "p_down")) + ">"
    b = spark.createDataFrame([], f"as_of date, cluster int, vector array<double>, regime string, sector string, decayed double, freshness double, buy {side}")
    out = S.distribution(a, b, "buy")
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().analyzed().toString() and out.count() == 0


def test_clusters_shuffle_no_memory(spark, monkeypatch):
    """With facts apart, each date's memory is neither shuffled nor written; the prototypes are the same."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 7)
    draw = random.Random(5)
    vectors = [[draw.uniform(-1, 1) for _ in range(2)] for _ in range(60)]
    side = "label string, mae double, mfe double, after_cost double"
    kinds = f"row_id long, day date, quality double, liquidity double, regime string, sector string, buy struct<{side}>, sell struct<{side}>"
    facts = spark.createDataFrame([(i, DAY, draw.random(), draw.random(), "UP", "1", ("FLAT", 0.1, 0.2, i / 64), ("UP_FIRST", 0.1, 0.2, -i / 64)) for i in range(60)], kinds)
    ids = spark.createDataFrame([(DAY + dt.timedelta(d), i, v) for d in (1, 2) for i, v in enumerate(vectors) if (i + d) % 5], "as_of date, row_id long, vector array<double>").repartition(3)
    cols = ("as_of", "cluster", "vector", "support", "last_day", "regime", "sector", "freshness", "buy.median", "sell.q10")
    rows = lambda p: sorted(map(str, p.select(*cols).collect()))
    got = rows(S.prototypes(ids, 0.9, facts=facts))
    assert got == rows(S.prototypes(ids.join(facts, "row_id"), 0.9)) and len(got) > 10
    first = K._first_ids(ids, 7)
    assert {r["as_of"]: r["last"] for r in first.collect()} == {DAY + dt.timedelta(1): 7, DAY + dt.timedelta(2): 7}


def test_continuations_are_folded_in_one_pass_a_task(spark):
    """No call a key; a key that goes on in the next batch keeps its state, and a null key is a key."""
    draw = random.Random(8)
    rows = [(k, DAY + dt.timedelta(d), 100 * (1 + draw.uniform(-0.1, 0.1))) for k in (1, 2, None, 3) for d in range(40)]
    bars = spark.createDataFrame(rows, "key long, day date, close double")
    out = lambda: K.trend_v2(bars, "UP", 3, 5, 0.05, 5.0, 1.0)
    assert "FlatMapGroupsInPandas" not in _plan(out())
    want = sorted(map(str, out().collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(map(str, out().collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and any("key=None" in r for r in got) and len(got) > 4


def test_ladders_shuffle_nothing(spark):
    o = spark.createDataFrame([(1, 50.0, 0.4, 9), (2, 0.03, -1.0, 59)], "id long, price double, strength double, quantity long")
    plan = K.ladder(o)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Sort", "Aggregate"))
    assert {r["id"]: r["n"] for r in K.ladder(o).groupBy("id").agg({"quantity": "sum"}).toDF("id", "n").collect()} == {1: 9, 2: 59}
