"""Standing legs over versions of predictions, against a plain loop over symbols and legs."""

import math
import random

import pytest

from tidemark.operators import rebalance as Z

LEGS = "leg_id long, symbol string, side string, limit_price double, note string"
PREDICTIONS = "version int, symbol string, price double, strength double, expected_up double, expected_down double"


def tick(x):
    return math.floor(round(x, 9) * 100 + 0.5) / 100


def loop(legs, predictions, versions):
    now, log, t = {leg[0]: list(leg) for leg in legs}, [], Z.RatchetTuning()
    for v in versions:
        before = {i: leg[3] for i, leg in now.items()}
        for _, symbol, cur, s, up, down in (p for p in predictions if p[0] == v):
            if not cur or cur <= 0 or s is None or abs(s) < 0.25:
                continue
            up, down = max(0, up or 0), max(0, down or 0)
            own = [leg for leg in now.values() if leg[1] == symbol and (before[leg[0]] or 0) > 0]
            near = lambda side, test=lambda x: True: min(((abs(cur - before[leg[0]]), leg[0], before[leg[0]]) for leg in own if leg[2] == side and test(before[leg[0]])), default=None)  # noqa: B023, E731
            for leg in own:
                old, new = before[leg[0]], None
                at = lambda share: tick(old + (cur - old) * share * math.exp(-abs(cur - old) / max(cur, 1e-6) / t.fade))  # noqa: B023, E731
                if s > 0 and leg[2] == "BUY" and (cur - near("BUY")[2]) / cur >= 0.01:
                    x = at(min(min(0.006, 0.003 + 0.5 * up) / 0.01, 0.7))
                    new = x if old < x < cur else None
                elif s > 0 and leg[2] == "SELL" and (near("SELL")[2] - cur) / cur <= 0.01:
                    x = at(min((0.003 + 0.5 * up) / 0.01, 0.7))
                    new = x if x > old and x > cur else None
                elif s < 0 and leg[2] == "BUY" and old < cur:
                    x = at(-min(min(0.006, 0.003 + 0.5 * down) / 0.01, 0.5))
                    new = x if x < old and x < cur else None
                elif s < 0 and leg[2] == "SELL" and old > cur:
                    x = max(at(-min(min(0.012, 0.003 + 0.5 * down) / 0.01, 0.5)), tick(cur * 1.0001))
                    new = x if cur < x < old and (near("SELL", lambda y: y > cur)[2] - cur) / cur >= 0.002 else None
                if new is not None:
                    leg[3] = new
                    log.append((v, leg[0], old, new, "RATCHET_UP" if s > 0 else "RATCHET_DOWN"))
    return now, log


def sample():
    r = random.Random(6)
    prices = {f"s{i}": r.uniform(20, 300) for i in range(12)}
    legs = []
    for i in range(300):
        symbol = "s0" if i % 3 == 0 else r.choice(list(prices))
        side = r.choice(("BUY", "SELL"))
        legs.append((i, symbol, side, round(prices[symbol] * (1 + (1 if side == "SELL" else -1) * r.uniform(-0.01, 0.09)), 2), "x"))
    predictions = [(v, s, p * r.uniform(0.98, 1.02), r.uniform(-1, 1), r.choice((None, 0.0, 0.004, 0.02)), r.uniform(-0.01, 0.02)) for v in range(4) for s, p in prices.items()]
    return legs, predictions


def test_versions_in_turn(spark):
    legs, predictions = sample()
    legs += [(900, "s0", "BUY", None, "n"), (901, "s0", "SELL", 0.0, "n"), (902, None, "BUY", 5.0, "n"), (903, "gone", "BUY", 5.0, "n")]
    predictions += [(0, "gone", None, 0.9, 0.0, 0.0), (1, "gone", 0.0, 0.9, 0.0, 0.0), (2, "gone", 10.0, None, 0.0, 0.0)]
    now, log = Z.rebalance(spark.createDataFrame(legs, LEGS).repartition(5), spark.createDataFrame(predictions, PREDICTIONS), range(4))
    want, moves = loop(legs, predictions, range(4))
    got = {r.leg_id: r for r in now.collect()}
    assert set(got) == set(want) and len(moves) > 200
    for i, r in got.items():
        assert (r.symbol, r.side, r.note) == tuple(want[i][j] for j in (1, 2, 4)) and r.limit_price == (want[i][3] if want[i][3] is None else pytest.approx(want[i][3], abs=1e-9))
    rows = sorted((r.version, r.leg_id, round(r.old_price, 6), round(r.new_price, 6), r.action) for r in log.collect())
    assert rows == sorted((v, i, round(a, 6), round(b, 6), n) for v, i, a, b, n in moves)
    price = {(p[0], p[1]): p[2] for p in predictions}
    side = {leg[0]: leg[1:3] for leg in legs}
    for v, i, old, new, action in rows:  # one way, and on its side of the price
        assert (new > old) == (action == "RATCHET_UP") and (new < price[v, side[i][0]]) == (side[i][1] == "BUY")


def test_nothing_to_do(spark):
    legs, predictions = spark.createDataFrame([], LEGS), spark.createDataFrame([(0, "s", 1.0, 1.0, 0.0, 0.0)], PREDICTIONS)
    now, log = Z.rebalance(legs, predictions, [0])
    assert now.collect() == [] == log.collect()
    now, log = Z.rebalance(spark.createDataFrame([(1, "s", "BUY", 0.5, "x")], LEGS), predictions.limit(0), [])
    assert now.count() == 1 and log.collect() == []


def test_a_leg_carries_its_moves(spark):
    """What a leg has been through is in its row: nothing is joined or grouped by leg, and equal ids stay apart."""
    legs = spark.createDataFrame([(1, "s", "BUY", 95.0, "x"), (1, "s", "BUY", 90.0, "y"), (2, "t", "SELL", 9.0, "x")], LEGS)
    predictions = spark.createDataFrame([(v, "s", 100.0, 0.9, 0.02, 0.0) for v in range(2)], PREDICTIONS)
    got = {(r.leg_id, r.note): [(m.version, m.old_price) for m in r.moves] for r in Z.carried(legs, predictions, range(2)).collect()}
    assert [m[0] for m in got[1, "x"]] == [0, 1] and got[1, "x"][0][1] == 95.0 and got[1, "y"][0][1] == 90.0 and got[2, "x"] == []
