"""Walk-forward evaluation against plain Python."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import backtest as B

DAY = datetime.date(2024, 1, 1)
BARS = "key long, day date, open double, high double, low double, close double, volume long"


def bars_of(keys, days, seed=1, hot=None):
    r = np.random.default_rng(seed)
    rows = []
    for k in keys:
        price = 100.0
        for d in range(days * (4 if k == hot else 1)):
            o, c = price, price * float(np.exp(r.normal(0, 0.03)))
            rows.append((k, DAY + datetime.timedelta(d), o, max(o, c) * 1.01, min(o, c) * 0.99, c, int(r.integers(1, 900))))
            price = c
    return rows


def test_neighbour_backtest_by_hand(spark):
    """Signals and results recomputed from the windows by comparing all pairs; keys without bars enough have zeros."""
    rows = bars_of((0, 1, 2), 40) + bars_of((3,), 5)
    bars = spark.createDataFrame(rows, BARS)
    made = {(r.key, r.day): r for r in B.path_windows(bars, 6, 4).collect()}
    by_key = {k: sorted(r for r in rows if r[0] == k) for k in range(4)}
    assert set(made) == {(k, by_key[k][i][1]) for k in range(3) for i in range(6, 36)}
    want = dict.fromkeys(range(4), (0, 0, 0))
    for k in range(3):
        for i in range(6, 36):
            at, own = made[k, by_key[k][i][1]], by_key[k]
            assert (at.entry, at.exit, at.exit_day, at.peak) == (own[i + 1][2], own[i + 4][5], own[i + 4][1], max(b[3] for b in own[i : i + 5]))
            pool = [r for r in made.values() if r.exit_day < at.day]
            q = np.array(at.vector)
            sims = sorted(((float(q @ np.array(p.vector)) / np.linalg.norm(q) / np.linalg.norm(p.vector), p) for p in pool), key=lambda x: -x[0])[:2]
            if len(sims) == 2 and sims[0][0] >= 0.4 and all(p.exit > p.entry for _, p in sims):
                n, right, peaks = want[k]
                want[k] = (n + 1, right + (at.exit > at.entry), peaks + ((at.peak - at.entry) / at.entry >= 0.05))
    got = {r.key: (r.signals, r.correct, r.peaks) for r in B.neighbour_backtest(bars, F.col("key") >= 0, 6, 2, 4, 0.4).collect()}
    assert got == want and sum(n for n, _, _ in want.values()) > 5


def test_neighbour_backtest_of_nothing(spark):
    assert B.neighbour_backtest(spark.createDataFrame([], BARS), F.col("key") >= 0).collect() == []
    flat = [(1, DAY + datetime.timedelta(d), 0.0, 0.0, 0.0, 0.0, 0) for d in range(30)]
    row = B.neighbour_backtest(spark.createDataFrame(flat, BARS), F.col("key") >= 0, 5, 1, 2, -1.0).first()
    assert (row.signals, row.win_rate, row.return_rate) == (0, 0.0, 0.0)
