"""Fold ranges and metrics against plain Python over the rows of each fold."""

import datetime
import math
import random

import pytest

from tidemark.operators import folds as D

DAY = datetime.date(2024, 3, 1)
SCHEMA = "key string, day date, side string, score double, filled boolean, ret double, entry_day date, exit_day date, notional double"


def day(n):
    return None if n is None else DAY + datetime.timedelta(n)


def plans(seed, n=260, days=24, hot=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        d = r.randrange(days)
        filled = r.random() < 0.8
        score = None if i % 50 == 49 else round(r.random(), 3)
        rows.append(("hot" if hot and i % 3 == 0 else f"k{r.randrange(9)}", day(d), r.choice(("BUY", "SELL")), score, filled, r.gauss(0.01, 0.05) if filled else 0.0, day(d + 1), day(d + 1 + r.randrange(4)) if i % 40 else None, 100.0 * r.randrange(1, 9)))
    return rows


def metrics(rows, test, train, days):
    """``test`` and ``train`` are lists of half-open ranges."""
    at = {d: i for i, d in enumerate(days)}
    inside = lambda r, part: any(lo <= at[r[1]] < hi for lo, hi in part)
    t, f = [r for r in rows if inside(r, test)], [r for r in rows if inside(r, train)]
    done = [r for r in t if r[4]]
    rets = [r[5] for r in done]
    mean = lambda x: sum(x) / len(x) if x else 0.0
    equity = peak = fall = 0.0
    for d in days:
        equity += sum(r[5] for r in done if r[1] == d)
        peak, fall = max(peak, equity), max(fall, max(peak, equity) - equity)
    ordered, buckets, seen = sorted(t, key=lambda r: round((r[3] or 0) * 1000)), {}, 0
    size = max(1, len(t) // 5)
    for s in sorted({round((r[3] or 0) * 1000) for r in t}):
        rs = [r for r in ordered if round((r[3] or 0) * 1000) == s]
        buckets.setdefault(seen // size, []).extend(rs)
        seen += len(rs)
    means = [mean([r[5] for r in b if r[4]]) for b in buckets.values()]
    gaps = [abs(mean([r[3] or 0 for r in b]) - sum(r[4] and r[5] > 0 for r in b) / max(1, sum(r[4] for r in b))) for b in buckets.values()]
    pairs = sum(
        a[0] == b[0] and None not in (a[7], b[7]) and not (a[7] < b[6] or b[7] < a[6]) for i, a in enumerate(done) for b in done[i + 1 :]
    )
    leaks = sum(r[7] is not None and any(lo > at[r[1]] and r[7] >= days[lo] for lo, _ in other) for part, other in ((t, train), (f, test)) for r in part)

    def sharpe(share):
        if len(rets) < 2:
            return 0.0
        mu = mean(rets) * share
        sd = math.sqrt(max(sum((x - mu) ** 2 for x in rets) / (len(rets) - 1), 1e-12))
        return 0.5 * (1 + math.erf(mu / (sd / math.sqrt(len(rets))) / math.sqrt(2)))

    best = sorted(t, key=lambda r: (-(r[3] or 0), at[r[1]], r[0], r[2]))[:2]
    n = len(done)
    out = {
        "train_plans": len(f), "train_expectancy": mean([r[5] for r in f if r[4]]), "plans": len(t), "filled": n, "expectancy": mean(rets), "total": sum(rets), "max_drawdown": fall, "turnover": sum(r[8] for r in done),
        "hit_rate": sum(x > 0 for x in rets) / max(n, 1), "coverage": n / max(len(t), 1), "no_trade_ratio": (len(t) - n) / max(len(t), 1), "precision_at_k": sum(r[4] and r[5] > 0 for r in best) / max(1, sum(r[4] for r in best)),
        "longs": sum(r[2] == "BUY" for r in done), "long_expectancy": mean([r[5] for r in done if r[2] == "BUY"]), "shorts": sum(r[2] == "SELL" for r in done), "short_expectancy": mean([r[5] for r in done if r[2] == "SELL"]),
        "psr": sharpe(1), "dsr": sharpe(0.9), "monotonic": all(a <= b for a, b in zip(means, means[1:], strict=False)), "calibration_error": mean(gaps), "effective_size": n if n <= 1 else n / (1 + pairs / n), "leaks": leaks,
    }
    why = []
    if out["expectancy"] <= 0:
        why += ["non_positive_expectancy"]
    if max(out["psr"], out["dsr"]) < 0.55:
        why += ["low_psr", "low_psr_or_dsr"]
    if not out["monotonic"]:
        why += ["non_monotonic_bucket", "non_monotonic_score_buckets"]
    if out["calibration_error"] > 0.25:
        why += ["high_ece", "high_calibration_error"]
    return out | {"rejections": why}


def walks(n, horizon):
    purge, embargo = D.purge_and_embargo(horizon)
    train, out, start = max(1, n // 2), [], 0
    test = max(1, min(horizon, max(1, n - train - purge - embargo)))
    while start + train + purge + embargo + test <= n:
        lo = start + train + purge + embargo
        out.append(([(lo, lo + test)], [(start, start + train)]))
        start += test
    return out


def test_purge_and_embargo():
    assert D.purge_and_embargo(5, 1.0) == (4, 5) and D.purge_and_embargo(5, 1.1) == (4, 6) and D.purge_and_embargo(0, 0.0) == (1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_forward(spark, seed):
    rows = plans(seed)
    days = sorted({r[1] for r in rows})
    got = D.evaluate(spark.createDataFrame(rows, SCHEMA).repartition(5), lambda d: D.walk_forward_ranges(d, 3)).collect()
    want = walks(len(days), 3)
    assert [r.fold for r in got] == list(range(len(want))) and want
    for r, (test, train) in zip(got, want, strict=True):
        for name, value in metrics(rows, test, train, days).items():
            assert r[name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), name


def test_combinatorial_with_leaks_and_aggregate(spark):
    rows = plans(3) + plans(3, 30)  # repeated rows
    days = sorted({r[1] for r in rows})
    n, groups, (purge, embargo) = len(days), 5, D.purge_and_embargo(2)
    got = D.evaluate(spark.createDataFrame(rows, SCHEMA), lambda d: D.combinatorial_ranges(d, groups, 2, 2)).collect()
    folds = [(i, j) for i in range(groups) for j in range(i + 1, groups)]
    assert [r.fold for r in got] == list(range(len(folds)))
    made = []
    for r, chosen in zip(got, folds, strict=True):
        test, train, begin = [(g * n // groups, (g + 1) * n // groups) for g in chosen], [], 0
        for lo, hi in test:
            train.append((begin, lo - purge))
            begin = hi + embargo
        train = [(lo, hi) for lo, hi in [*train, (begin, n)] if lo < hi]
        made.append(metrics(rows, test, train, days))
        for name, value in made[-1].items():
            assert r[name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (chosen, name)
    assert any(m["leaks"] for m in made)
    w = [max(m["effective_size"], m["longs"] + m["shorts"], 1) for m in made]
    one = D.aggregate(spark.createDataFrame(got)).first()
    for name in ("expectancy", "psr", "dsr", "calibration_error"):
        assert one[name] == pytest.approx(sum(x * m[name] for x, m in zip(w, made, strict=True)) / sum(w))
    assert (one.folds, one.leak_free, one.total) == (len(folds), False, pytest.approx(sum(m["total"] for m in made)))


def test_none_few_and_null_rows(spark):
    none = D.evaluate(spark.createDataFrame([], SCHEMA), lambda d: D.walk_forward_ranges(d, 3))
    assert none.collect() == [] and D.aggregate(none).collect() == []
    assert D.evaluate(spark.createDataFrame([], SCHEMA), lambda d: D.combinatorial_ranges(d, 4, 2, 3)).collect() == []
    two = [("a", day(0), "BUY", 0.5, True, 0.1, day(1), day(2), 1.0), ("a", day(1), "BUY", 0.5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    assert D.evaluate(spark.createDataFrame(two, SCHEMA), lambda d: D.walk_forward_ranges(d, 3)).collect() == []
    odd = [(None, day(i), None, None, i % 2 == 0, None, None, None, None) for i in range(12)]
    got = D.evaluate(spark.createDataFrame(odd, SCHEMA), lambda d: D.walk_forward_ranges(d, 1)).collect()
    assert len(got) == len(walks(12, 1)) and all(r.longs == r.shorts == r.leaks == 0 and r.total == 0 for r in got)
