"""Flows on small tables: ties, nulls, empty sides and what must not look ahead."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import flows as L
from tidemark.operators import kernels as K
from tidemark.operators import relational as R
from tidemark.operators import statistics as A
from tidemark.operators import vectors as X


def day(n):
    return datetime.date(2024, 1, n)


def test_best_signals(spark):
    signals = spark.createDataFrame([(1, 0.9), (2, 0.9), (3, 0.4), (4, 0.8), (5, None), (6, -0.9)], "id int, signal double")
    recs = spark.createDataFrame([(2, "LONG"), (2, "LONG"), (4, "SHORT"), (1, None)], "id int, side string")
    assert [tuple(r) for r in L.best_signals(signals, recs, "id", 0.5, 10).collect()] == [(1, 0.9, False), (2, 0.9, True)]
    assert [r.id for r in L.best_signals(signals, recs.limit(0), "id", 0.5, 2, selling=True).collect()] == [6]
    assert L.best_signals(signals.limit(0), recs, "id", 0.5, 2).collect() == []


def test_reports(spark):
    rows = [("a", day(1), 1.0), ("a", day(3), 2.0), ("a", day(9), 3.0), ("b", None, 4.0), ("c", day(2), 5.0), ("d", day(8), 6.0), ("d", None, 7.0)]
    got = {r.k: tuple(r)[1:] for r in L.reported_and_upcoming(spark.createDataFrame(rows, "k string, at date, eps double"), "k", "at", "eps", F.lit(day(5))).collect()}
    assert got == {"a": (2.0, day(3), 3.0, day(9)), "b": (None, None, 4.0, None), "c": (5.0, day(2), None, None), "d": (None, None, 6.0, day(8))}


def test_context_looks_back_only(spark):
    days = spark.createDataFrame([(day(n),) for n in (1, 2, 4)], "day date")
    seen = spark.createDataFrame([("x", day(1), 2.0), ("x", day(3), 4.0), ("y", day(1), 5.0), ("y", day(4), 9.0)], "name string, day date, value double")
    breadth = spark.createDataFrame([(day(1), 0.5), (day(4), 1.0)], "day date, breadth double")
    got = {r.day: list(r.vector) for r in L.context_vectors(days, seen, breadth, ["y", "x"], 2.0, 4).collect()}
    assert got[day(1)] == [0.0] * 4
    assert got[day(2)] == pytest.approx([0, 0, 1, 0])
    n = math.hypot(math.log(2), 1)
    assert got[day(4)] == pytest.approx([math.log(2) / n, 0, 1 / n, 0])


def test_folds_that_leak(spark):
    rows = spark.createDataFrame([(day(n), float(n)) for n in range(1, 11)], "day date, x double")
    folds = spark.createDataFrame([(0, day(1), day(5), day(6), day(8)), (1, day(4), day(9), day(2), day(4)), (2, day(20), day(25), day(26), day(28))], "fold int, train_from date, train_to date, test_from date, test_to date")
    got = {r.fold: r for r in L.fold_validation(rows, folds, "day", "x").collect()}
    assert set(got) == {0, 1} and got[0].leak_free and not got[1].leak_free
    assert (got[0].train_mean, got[0].test_mean, got[0].train_n) == (2.5, 6.5, 4) and got[0].train_std == pytest.approx(math.sqrt(1.25))


def test_overlaps_and_ranks(spark):
    rows = [("k", i, day(1 + i * 2), day(1 + i * 2 + i % 4 * 3)) for i in range(9)] + [("z", 1, day(1), day(30)), ("z", 2, day(15), day(15))]
    got = sorted((r.k, r.a_i, r.b_i) for r in R.overlaps(spark.createDataFrame(rows, "k string, i int, a date, b date"), "k", "i", "a", "b", 3).collect())
    assert got == sorted((p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and p[2] <= q[3] and q[2] <= p[3])
    values = [3.0, 1.0, 2.0, 2.0, 5.0, None]
    ranks = {r.x: r.rank for r in A.percent_ranks(spark.createDataFrame([(v,) for v in values], "x double"), "x", "rank").collect()}
    assert ranks == {1.0: 0.0, 2.0: 0.25, 3.0: 0.75, 5.0: 1.0}


def test_portfolio_with_overlap_and_cash(spark):
    rows = [(day(2), 1, "T", "BUY", 0.9, 0.0), (day(2), 2, "U", "BUY", 0.8, 2.0), (day(2), 3, "V", "BUY", 0.5, 0.0), (day(3), 1, "T", "BUY", 0.9, 0.0)]
    c = spark.createDataFrame(rows, "day date, id int, sector string, side string, ev double, overlap double")
    c = c.withColumns({"uncertainty": F.lit(0.0), "confidence": F.lit(0.5), "policy_utility": F.lit(0.1), "size": F.lit(1.0), "no_trade": F.lit(False), "held": F.lit(False)})
    got = {(r.day, r.id): r.budget for r in K.select_portfolio(c, 1000.0, top=2, cash=500.0, reserved=100.0).collect()}
    assert got[day(2), 2] == 0 and got[day(2), 1] > 0 and got[day(2), 3] > 0 and got[day(2), 1] + got[day(2), 3] <= 400 + 1e-9 and got[day(3), 1] > 0


def test_signal_at_a_tie_and_weights_of_any_size(spark):
    """A tie is no rise; two matches each way, reranked with weights that do not add up to one."""
    tie = spark.createDataFrame([(1, "UP", 0.5), (1, "DOWN", 0.5), (2, "UP", 0.6), (2, "DOWN", 0.5), (3, "DOWN", 0.9)], "q long, direction string, sim double")
    got = {r.q: (r.p_up, r.signal) for r in X.directional_signal(tie).collect()}
    assert got[1] == (0.5, -0.5) and got[2][1] == got[2][0] > 0.5 and got[3][1] < -0.99
    matches = spark.createDataFrame([(1, "UP", i, s, c) for i, (s, c) in enumerate([(0.9, 0.1), (0.5, 0.6)])], "q long, direction string, id int, shape_sim double, ctx_sim double")
    one, many = ([(r.id, round(r.sim, 12)) for r in L.reranked(matches, a, b, 2).orderBy("rank").collect()] for a, b in ((0.25, 0.75), (1.0, 3.0)))
    assert one == many == [(1, 0.575), (0, 0.3)]
