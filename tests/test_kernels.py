"""Kernels without SQL, held against plain Python, pandas and NumPy, and against published golden values."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels as K
from tidemark.operators import planning as P
from tidemark.operators import research as S
from tidemark.operators import shapes as H
from tidemark.operators import statistics as A
from tidemark.operators import windows as W

BAR = "key string, day date, open double, high double, low double, close double, volume long"


def walk(keys="ABC", n=90, seed=3):
    r, out = random.Random(seed), []
    for k in keys:
        p = 100.0
        for i in range(n):
            o = p
            p = max(5.0, p * (1 + r.gauss(0, 0.03)))
            out.append((k, datetime.date(2024, 1, 1) + datetime.timedelta(i), o, max(o, p) * (1 + r.random() / 50), min(o, p) * (1 - r.random() / 50), p, r.randint(100, 999)))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(), BAR).cache()


@pytest.fixture(scope="module")
def frames():
    df = pd.DataFrame(walk(), columns=["key", "day", "open", "high", "low", "close", "volume"])
    return dict(list(df.groupby("key")))


def test_indicators_match_pandas(bars, frames):
    got = W.indicators(bars).orderBy("key", "day").toPandas()
    for k, df in frames.items():
        g, c = got[got.key == k].reset_index(drop=True), df.close.reset_index(drop=True)
        e12, e26 = (c.ewm(span=n, min_periods=n).mean() for n in (12, 26))
        tr = pd.concat([df.high - df.low, (df.high - df.close.shift()).abs(), (df.low - df.close.shift()).abs()], axis=1).max(axis=1).reset_index(drop=True)
        d = c.diff()
        rs = d.where(d > 0, 0).rolling(14).mean() / (-d.where(d < 0, 0)).rolling(14).mean()
        want = {"macd": e12 - e26, "macd_signal": (e12 - e26).ewm(span=9, min_periods=9).mean(), "atr": tr.ewm(span=14, min_periods=14).mean(), "rsi": 100 - 100 / (1 + rs), "bb_upper": c.rolling(20).mean() + 2 * c.rolling(20).std()}
        for name, w in want.items():
            assert g[name].astype(float).to_numpy() == pytest.approx(w.to_numpy(), nan_ok=True, rel=1e-9), name


def test_outcomes_of_both_sides(bars, frames):
    got = {(r.key, r.day): r for r in K.event_outcomes(bars, 4, 0.03, 0.02, 5, 5, 0.004).collect()}
    seen = set()
    for k, df in frames.items():
        rows = list(df.itertuples())
        for i, row in enumerate(rows):
            ahead = rows[i + 1 : i + 5]
            if not ahead:
                assert (k, row.day) not in got
                continue
            r, e = got[(k, row.day)], ahead[0].open
            gross = ahead[-1].close / e - 1
            two = False
            for side, sign in (("buy", 1), ("sell", -1)):
                if sign > 0:
                    t = [b.high >= e * 1.03 for b in ahead]
                    s = [b.low <= e * 0.98 for b in ahead]
                else:
                    t = [b.low <= e * 0.97 for b in ahead]
                    s = [b.high >= e * 1.02 for b in ahead]
                two |= any(map(all, zip(t, s)))
                r_side = r[side]
                td, sd = (x.index(True) + 1 if any(x) else None for x in (t, s))
                assert (r_side.target_day, r_side.stop_day) == (td, sd)
                net = sign * gross - 0.001
                if td and sd and td == sd:
                    label = "AMBIGUOUS"
                elif td and (not sd or td < sd):
                    label = "UP_FIRST"
                elif sd:
                    label = "DOWN_FIRST"
                else:
                    label = "FLAT" if abs(net) <= 0.004 else "HORIZON_UP" if net > 0 else "HORIZON_DOWN"
                assert r_side.label == label and r_side.after_cost == pytest.approx(net)
                seen.add(label)
                best, worst = max(0, *(sign * (x / e - 1) for b in ahead for x in (b.high, b.low))), min(0, *(sign * (x / e - 1) for b in ahead for x in (b.high, b.low)))
                assert r_side.mfe == pytest.approx(best) and r_side.mae == pytest.approx(worst)
            assert r.path_label == ("AMBIGUOUS" if two else r.buy.label) and 0 <= r.quality <= 1 and r.end_day == ahead[-1].day > row.day
    assert len(seen) >= 5


@pytest.mark.parametrize("direction", ["UP", "DOWN"])
def test_trend_detectors(bars, frames, direction):
    back, ahead, least, reverse, k = 4, 6, 0.04, 0.08, 1.2
    up = direction == "UP"
    want = {"v1": set(), "v2": set(), "v4": set()}
    for key, df in frames.items():
        c, day = df.close.to_numpy(), df.day.to_numpy()
        noise = df.close.diff().abs().rolling(7).mean().to_numpy()
        recent, before, last = [], None, None
        for i in range(len(c)):
            fut = c[i + 1 : i + 1 + ahead]
            if len(fut) == ahead:
                hits = [j for j, v in enumerate(fut) if (v >= c[i] * (1 + least) if up else v <= c[i] * (1 - least))]
                if hits and (min(fut[hits[0] :]) >= fut[hits[0]] * (1 - reverse) if up else max(fut[hits[0] :]) <= fut[hits[0]] * (1 + reverse)):
                    want["v4"].add((key, day[i]))
            if not back <= i < len(c) - ahead:
                continue
            past, fut = c[i - back : i], c[i : i + ahead]
            slope = (past[-1] - past[0]) / back
            quiet = (slope <= 0 if up else slope >= 0) and np.std(past, ddof=1) < noise[i] * k
            change = (fut.max() - c[i] if up else c[i] - fut.min()) / c[i]
            if quiet and change >= least and ((c[i] - past.min() if up else past.max() - c[i]) / c[i]) <= reverse:
                want["v1"].add((key, day[i]))
            if quiet:
                continue
            against = abs((fut.min() - c[i] if up else fut.max() - c[i]) / c[i])
            ok = change >= least and against <= reverse
            gain = change - before if before is not None else 0.0
            if ok and gain > 0.35 * least and (not recent or change > max(recent)) and (last is None or i - last >= 2):
                want["v2"].add((key, day[i]))
                last = i
            if ok or before is None:
                before = change
            recent = (recent + [change])[-4:]
    args = (direction, back, ahead, least, reverse, k)
    found = {"v1": K.trend_v1(bars, *args), "v2": K.trend_v2(bars, *args), "v4": K.trend_v4(bars, direction, ahead, least, reverse)}
    for v, df in found.items():
        assert {(r.key, r.day) for r in df.collect()} == want[v] and want[v], v
    assert {(r.key, r.day) for r in K.trend_v3(bars, *args).collect()} == want["v1"] | want["v2"]


def test_ladder_golden(spark):
    t = K.LadderTuning(base_legs=2, base=0.012, least=0.006, most=0.05, floor=0.012, spread=0.01)
    rows = [("NVDA", 120.0, 0.86, 17, "UP_FIRST", -0.003, True), ("AAPL", 210.0, 0.71, 10, "DOWN_FIRST", -0.041, False), ("none", 10.0, 0.5, 0, None, None, None), ("free", 0.0, 0.5, 5, None, None, None)]
    got = K.ladder(spark.createDataFrame(rows, "id string, price double, strength double, quantity long, label string, adverse double, wanted boolean"), "US", "BUY", t).orderBy("id", "leg").collect()
    assert [(r.id, r.quantity, r.limit_price) for r in got] == [("AAPL", 7, 207.37), ("AAPL", 3, 201.07), ("NVDA", 13, 118.78), ("NVDA", 4, 115.17)]


def test_ladders_keep_quantity_and_gap(spark):
    r = random.Random(1)
    rows = [(i, round(r.uniform(3, 90000), 2), r.uniform(-1, 1), r.randint(1, 300)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, price double, strength double, quantity long")
    for market in ("US", "KR"):
        for side in ("BUY", "SELL"):
            legs = {}
            for leg in K.ladder(df, market, side).collect():
                legs.setdefault(leg.id, []).append(leg)
            for i, price, _, q in rows:
                own = sorted(legs[i], key=lambda x: x.leg)
                assert sum(x.quantity for x in own) == q and len(own) <= 6 and all(x.quantity > 0 for x in own)
                prices = [x.limit_price for x in own]
                assert prices == sorted(set(prices), reverse=side == "BUY")
                assert all(p < price for p in prices) if side == "BUY" else all(p > price for p in prices)


def test_budgets(spark):
    rows = [("b", 1, 100.0, 0.03, 0.9), ("b", 2, 50.0, 0.03, 0.5), ("b", 3, 20000.0, 0.03, 0.99), ("b", 4, 10.0, 0.03, 0.0), ("c", 5, 100.0, 0.05, 0.5)]
    got = {r.id: r.budget for r in K.allocate(spark.createDataFrame(rows, "batch string, id long, price double, atr_pct double, signal double"), 1000.0, weight=0.5).collect()}
    assert set(got) == {1, 2, 3, 5} and got[3] == pytest.approx(500.0) and got[1] + got[2] + got[3] <= 1000 + 1e-6 and got[5] <= 500 + 1e-9


def test_portfolio_reasons(spark):
    day = datetime.date(2024, 1, 2)
    rows = [(day, i, sec, side, ev, 0.0, 0.5, 0.1, 1.0, nt, held) for i, sec, side, ev, nt, held in [
        (1, "T", "BUY", 0.9, False, False), (2, "T", "BUY", 0.8, False, False), (3, "T", "SELL", 0.7, False, False), (4, "T", "SELL", 0.6, False, False), (5, "U", "BUY", -0.1, False, False), (6, "U", "BUY", 0.5, True, False), (7, "U", "BUY", 0.4, False, True), (8, "U", "BUY", 0.3, False, False)]]
    df = spark.createDataFrame(rows, "day date, id long, sector string, side string, ev double, uncertainty double, confidence double, policy_utility double, size double, no_trade boolean, held boolean")
    got = {r.id: (r.reason, r.budget) for r in K.select_portfolio(df, 1000.0).collect()}
    assert {i: w for i, (w, _) in got.items()} == {1: None, 2: "correlated_cap", 3: None, 4: "sector_cap", 5: "below_ev_threshold", 6: "quote_policy_no_trade", 7: "already_open", 8: None}
    assert sum(b for _, b in got.values()) <= 1000 and all(b == 0 for w, b in got.values() if w)


def test_fills(spark):
    d = lambda n: datetime.date(2024, 1, n)
    bars = spark.createDataFrame([("A", d(i), 10.0, 11.0, 9.0, 10.0, 1) for i in range(1, 8)], BAR)
    legs = spark.createDataFrame([("A", d(2), 1, "BUY", 9.5, 5), ("A", d(2), 2, "BUY", 10.5, 1), ("A", d(2), 3, "SELL", 20.0, 5)], "key string, day date, leg_id long, side string, limit_price double, quantity long")
    got = sorted(((r.leg_id, r.bar_day, r.filled, r.status, r.fill_price) for r in K.simulate_fills(legs, bars, slippage_bps=100).collect()), key=str)
    assert [x[:4] for x in got] == [(1, d(3), 2, "PARTIAL"), (1, d(4), 2, "PARTIAL"), (1, d(5), 1, "PARTIAL"), (2, d(3), 1, "FULL"), (3, None, 0, "UNFILLED")]
    assert got[0][4] == pytest.approx(9.595) and got[3][4] == pytest.approx(10.1)
    assert sum(r.filled for r in K.simulate_fills(legs, bars, cap=False).where("leg_id = 1").collect()) == 10


def test_leader_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, rng.normal(size=3).tolist()) for k in ("a", "b") for i in range(60)]
    got = {(r.as_of, r.row_id): r.cluster for r in K.leader_clusters(spark.createDataFrame(rows, "as_of string, row_id int, vector array<double>"), 0.8).collect()}
    for k in ("a", "b"):
        leaders = []
        for _, i, v in (r for r in rows if r[0] == k):
            u = np.array(v) / np.linalg.norm(v)
            hit = next((n for n, x in enumerate(leaders) if x @ u >= 0.8), None)
            if hit is None:
                leaders.append(u)
            assert got[(k, i)] == (len(leaders) - 1 if hit is None else hit)


def np_shape_v1(p, v, m=5):
    def z(x):
        return np.zeros_like(x) if x.std() < 1e-8 else np.clip((x - x.mean()) / x.std(), -5, 5)

    def res(x):
        return np.interp(np.linspace(0, len(x) - 1, m), np.arange(len(x)), x)

    lr, lv = np.diff(np.log(np.array(p) + 1e-9)), np.diff(np.log(np.array(v) + 1.0))
    runs = max((len(r) for r in "".join("u" if x > 0 else " " for x in lr).split()), default=0)
    rank = lambda x: np.argsort(np.argsort(x, kind="stable"), kind="stable")
    meta = [np.sqrt((lr**2).mean()), np.sqrt((np.minimum(lr, 0) ** 2).mean()), (lr > 0).mean(), runs, np.corrcoef(lr[:-1], lr[1:])[0, 1], np.polyfit(np.arange(len(lr)), lr, 1)[0], np.corrcoef(rank(lr), rank(lv))[0, 1]]
    return np.concatenate([res(z(lr)), res(z(lv)), 0.5 * np.tanh(meta)])


def test_shapes_match_numpy(spark, frames):
    df = next(iter(frames.values())).head(30)
    row = [tuple([float(x) for x in df[c]] for c in ("open", "high", "low", "close", "volume"))]
    d = spark.createDataFrame(row, ", ".join(f"{c} array<double>" for c in "ohlcv"))
    o, h, low, c, v = (F.col(x) for x in "ohlcv")
    got = d.select(H.shape_v1(c, v).alias("v1"), H.shape_v2(o, h, low, c, v).alias("v2"), H.premarket_shape(o, h, low, c, v, 5).alias("p")).first()
    assert got.v1 == pytest.approx(np_shape_v1(*(row[0][i] for i in (3, 4))).tolist(), abs=1e-9)
    assert len(got.v2) == 40 and got.v2[:10] == pytest.approx(got.v1[:10])
    body = np.diff([(c - o) / (o + 1e-9) for o, c in zip(row[0][0], row[0][3])])
    z = (body - body.mean()) / body.std()
    assert got.v2[10:15] == pytest.approx(np.interp(np.linspace(0, 28, 5), np.arange(29), np.clip(z, -5, 5)).tolist(), abs=1e-9)
    assert len(got.p) == 35 and np.linalg.norm(got.p) == pytest.approx(1, abs=1e-6)
    r = np.diff(np.log(row[0][3]))
    seg = [r[int(i * 29 / 5) : int((i + 1) * 29 / 5)].mean() for i in range(5)]
    assert np.array(got.p[:5]) / got.p[0] == pytest.approx(np.array(seg) / seg[0], rel=1e-4)


def test_statistics(spark):
    r = [0.01, -0.02, 0.03, 0.005, 0.012]
    got = A.sharpe_probability(spark.createDataFrame([(x,) for x in r], "r double"), "r").first()

    def psr(mu):
        sd = math.sqrt(sum((x - mu) ** 2 for x in r) / 4)
        return 0.5 * (1 + math.erf(mu / (sd / math.sqrt(5)) / math.sqrt(2)))

    m = sum(r) / 5
    assert (got.psr, got.dsr) == pytest.approx((psr(m), psr(0.9 * m)))
    assert A.walk_forward(30, 10, 5, 2)[0] == {"fold": 0, "train_from": 0, "train_to": 10, "test_from": 12, "test_to": 17}
    for f in A.combinatorial_folds(20, 5, 2, 1):
        assert not set(f["train"]) & set(f["test"]) and all(abs(a - b) > 1 for a in f["train"] for b in f["test"])
    assert A.rejections({"expectancy_after_cost": 1, "psr": 0.9, "score_decile_monotonicity": True, "calibration_error": 0.1}) == []
    assert A.overlap_adjusted_size(5, 10) == pytest.approx(10 / 1.5)


def test_planning_golden(spark):
    one = spark.range(1).select(P.buy_risk_multiplier(F.lit(-72), F.lit(81), F.lit(0.84)).alias("b"), P.sell_markup(F.lit(-72), F.lit(0.84)).alias("s")).first()
    assert (one.b, one.s) == (2.364, 1.0)


def test_no_look_ahead(spark, bars):
    """Cutting off the future changes no feature and no memory of the past."""
    cut = datetime.date(2024, 2, 20)
    early = bars.where(F.col("day") <= F.lit(cut))
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.where(F.col("day") <= F.lit(cut)).collect())
    assert rows(S.bar_features(bars)) == rows(S.bar_features(early))
    dates = spark.createDataFrame([(cut,)], "as_of date")
    known = lambda b: sorted((r.key, r.day) for r in S.memory_asof(K.event_outcomes(b), dates).select("key", "day").collect())
    full, part = known(bars), known(early)
    assert set(full) <= set(part) and full
