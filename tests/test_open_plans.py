"""Opening plans against published golden values, and against plain Python for codes, budgets and moved limits."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels as K
from tidemark.operators import open_plans as O

TUNING = K.LadderTuning(base_legs=2, spread=0.01, base=0.012, least=0.006, most=0.05, floor=0.012)
SCHEMA = "batch string, id long, price double, atr_pct double, signal double, multiplier double, earnings boolean"


def tick(x):
    return math.floor(round(x, 10) / 0.01 + 0.5) * 0.01


def test_golden_plan(spark):
    """fixed values: the published session of two candidates, 7,000 in cash"""
    rows = [("us", 101, 120.0, 0.032, 0.86, 0.0, "UP_FIRST", -0.003, True), ("us", 102, 210.0, 0.025, 0.71, 0.0, "DOWN_FIRST", -0.041, False)]
    c = spark.createDataFrame(rows, "batch string, id long, price double, atr_pct double, signal double, gain double, label string, adverse double, wanted boolean")
    got = O.buy_plans(c, 7_000.0, tuning=TUNING, weight=0.30, penalty=2.0).orderBy("id", "leg").collect()
    assert [(r.id, r.code, r.budget, r.leg, r.limit_price, r.quantity) for r in got] == [
        (101, "OK", 2100.0, 1, 118.78, 13), (101, "OK", 2100.0, 2, 115.17, 4), (102, "OK", 2100.0, 1, 207.37, 7), (102, "OK", 2100.0, 2, 201.07, 3),
    ]


def budgets(rows, cash, legs=3, soft=2.0, weight=0.3, penalty=2.0):
    size = len(rows)
    cap = min(soft * cash / size, weight * cash)
    scored = []
    for r in rows:
        price, atr, signal = r[2] or 0.0, 0.05 if r[3] is None else r[3], r[4] or 0.0
        if price > 0 and signal > 0:
            first = tick(price * (1 - max(0.012, 0.4 * atr)))
            scored.append((signal / max(price * atr, 1e-9) * min(1, cap / max(legs * first, 1e-9)) ** penalty, price, r[1], min(legs * first, cap), first))
    run, kept = 0.0, []
    for x in sorted(scored, key=lambda x: (x[1], x[2])):
        run += x[3]
        if run <= cash:
            kept.append(x)
    rest, total, out = cash - sum(x[3] for x in kept), sum(x[0] for x in kept), {}
    for p, _, i, need, _ in sorted(kept, key=lambda x: (-x[0], x[1], x[2])):
        more = max(0.0, min(cap - need, rest * p / total))
        out[i], rest = need + more, rest - more
    return out, {x[2]: x[4] for x in scored}


def sample():
    rows = [("hot" if i % 3 else f"b{i % 5}", i, 5.0 + (i * 37 % 900), (i % 7 + 1) / 100, (i % 9) / 8, 1 + (i % 5) / 4, i % 4 == 0) for i in range(120)]
    rows += [("hot", 900, None, 0.05, 0.5, 1.0, False), ("hot", 901, -3.0, 0.05, 0.5, 1.0, False), ("hot", 902, 50.0, None, 0.5, None, None), ("hot", 903, 50.0, 0.05, None, 1.0, True), (None, 904, 20.0, 0.05, 0.5, 2.0, True), ("dear", 905, 50_000.0, 0.05, 0.5, 1.0, False)]
    return rows


def test_every_candidate_ends_once(spark):
    rows, cash = sample(), 9_000.0
    got = O.buy_plans(spark.createDataFrame(rows, SCHEMA).repartition(5), cash, weight=0.3, penalty=2.0, micro=False).collect()
    plain = {(r.id[1], r.leg): (r.limit_price, r.quantity) for r in K.ladder(
        spark.createDataFrame([((r[0], r[1]), r[2], r[4], u) for r in rows for u in [units(rows, r, cash)] if u >= 3], "id struct<batch:string,id:long>, price double, strength double, quantity long")).collect()}
    by_id = {}
    for g in got:
        by_id.setdefault(g.id, []).append(g)
    assert set(by_id) == {r[1] for r in rows}
    codes = set()
    for r in rows:
        own, n = by_id[r[1]], units(rows, r, cash)
        allowed, _ = budgets([x for x in rows if x[0] == r[0]], cash)
        want = "INVALID" if not (r[2] or 0) > 0 or not (r[4] or 0) > 0 else "BUDGET_ALLOCATION" if r[1] not in allowed else "BUDGET" if n <= 0 else "GRANULARITY" if n < 3 else "OK"
        codes.add(want)
        assert {g.code for g in own} == {want} and own[0].budget == (pytest.approx(allowed[r[1]]) if r[1] in allowed else None)
        if want != "OK":
            assert len(own) == 1 and own[0].leg is None
            continue
        legs = {k: v for k, v in plain.items() if k[0] == r[1]}
        assert len(own) == len(legs) and sum(g.quantity for g in own) == n
        for g in own:
            limit, quantity = legs[r[1], g.leg]
            for m in (r[5] or 1.0, 2.0 if r[6] else 1.0):
                if m > 1:
                    limit = tick(r[2] * (1 - min(0.95, max(0.0, 1 - limit / r[2]) * m)))
            assert g.quantity == quantity and g.limit_price == pytest.approx(limit, abs=0.0201)  # half cents fall either way, and earnings double it
    assert codes == {"INVALID", "BUDGET_ALLOCATION", "BUDGET", "GRANULARITY", "OK"}


def units(rows, r, cash):
    allowed, first = budgets([x for x in rows if x[0] == r[0]], cash)
    return math.floor(allowed[r[1]] / first[r[1]]) if r[1] in allowed else 0


def test_moved_out_limits(spark):
    rows = [(100.0, 98.0, 1.5), (100.0, 98.0, 1.0), (100.0, 98.0, 0.5), (100.0, 20.0, 3.0), (0.0, 98.0, 2.0), (100.0, 0.0, 2.0), (100.0, 105.0, 2.0), (100.0, None, 2.0)]
    df = spark.createDataFrame(rows, "p double, l double, m double")
    buy, sell = ([r[0] for r in df.select(O.moved_out(F.col("p"), F.col("l"), F.col("m"), "US", s)).collect()] for s in ("BUY", "SELL"))
    assert buy == [97.0, 98.0, 98.0, 5.0, 98.0, 0.0, 100.0, None] and sell == [100.0, 98.0, 98.0, 100.0, 98.0, 0.0, 110.0, None]


def test_no_candidates(spark):
    assert O.buy_plans(spark.createDataFrame([], SCHEMA), 100.0).collect() == []
