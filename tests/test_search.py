"""Parameter search: proposals, rounds that are taken up again, and trials against plain Python."""

import datetime
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search as P

DAY = datetime.date(2024, 1, 1)
SPACE = {"a": [0, 1, 2, 3, 4], "b": [0.0, 0.5, 1.0], "c": [1, 2, 3, 4]}


def value(a, b, c):
    return -((a - 3) ** 2) - 4 * (b - 0.5) ** 2 - (c - 2) ** 2


def evaluate(trials):
    return trials.withColumn("value", -F.pow(F.col("a") - 3, F.lit(2)) - 4 * F.pow(F.col("b") - 0.5, F.lit(2)) - F.pow(F.col("c") - 2, F.lit(2)))


def run_plain(seed, trials, batch=8):
    done = []
    while len(done) < trials:
        points = P.propose(SPACE, done, min(batch, trials - len(done)), seed)
        if not points:
            break
        done += [(p, value(*p)) for p in points]
    return done


def test_proposals_repeat_nothing_and_end():
    done = run_plain(1, 1_000)
    assert len(done) == len({p for p, _ in done}) == 60 and {p for p, _ in done} == set(itertools.product(*SPACE.values()))
    assert run_plain(1, 30) == run_plain(1, 30) == done[:30][: len(run_plain(1, 30))] != run_plain(2, 30)
    assert P.propose({"a": [1]}, [((1,), 0.0)], 5, 0) == []


def test_density_ratio_finds_more_than_chance():
    """With a third of the grid tried, the best point is there for most seeds; even draws have it a third of the time."""
    hits = sum(((3, 0.5, 2), 0.0) in run_plain(seed, 20, 4) for seed in range(40))
    assert hits >= 24


def test_huge_grids_are_not_listed():
    wide = {f"p{i}": list(range(50)) for i in range(11)}
    done = [(p, float(-sum(p))) for p in P.propose(wide, [], 40, 3)]
    more = P.propose(wide, done, 10, 3)
    assert len({p for p, _ in done} | set(more)) == 50
    assert sum(map(sum, more)) / 10 < sum(sum(p) for p, _ in done) / 40


def test_rounds_are_taken_up_again(spark, tmp_path):
    """A search broken off between rounds, or in the middle of writing one, goes on to the same trials."""
    calls = []

    def counted(trials):
        calls.append(1)
        return evaluate(trials)

    whole = sorted(tuple(r) for r in P.search(spark, SPACE, counted, 20, str(tmp_path / "a"), 7, 8).collect())
    assert len(calls) == 3 and [r[0] for r in whole] == list(range(20))
    P.search(spark, SPACE, counted, 8, str(tmp_path / "b"), 7, 8)
    os.makedirs(tmp_path / "b" / "round-00001")  # begun, without the mark of a finished write
    (tmp_path / "b" / "round-00001" / "part-0").write_text("x")
    again = sorted(tuple(r) for r in P.search(spark, SPACE, counted, 20, str(tmp_path / "b"), 7, 8).collect())
    assert again == whole and len(calls) == 6
    P.search(spark, SPACE, counted, 20, str(tmp_path / "b"), 7, 8)
    assert len(calls) == 6


def test_trials_against_plain_python(spark):
    """A hot side, null scores, returns and sides, empty ranges: sums from prefixes equal those over the rows."""
    r = random.Random(2)
    rows = []
    for i in range(400):
        filled = r.random() < 0.8
        rows.append((i % 4 - 1 if i % 30 else None, "BUY" if i % 3 else "SELL" if i % 31 else None, None if i % 37 == 0 else round(r.random(), 3), filled if i % 41 else None, (r.gauss(0.02, 0.05) if i % 43 else None)))
    df = spark.createDataFrame(rows, "fold int, side string, score double, filled boolean, ret double")
    trials = [(0, 0.0, 0, 1.0), (1, 0.2, 1, 0.3), (2, 0.5, 2, 0.1), (3, 0.9, 0, 0.5), (4, 0.0, 2, 0.0)]
    asked = spark.createDataFrame(trials, "trial int, low double, sides int, width double")
    got = {t.trial: t for t in P.score_range_trials(P.score_prefixes(df, F.col("fold")))(asked).collect()}
    for t, low, sides, width in trials:
        inside = [x for x in rows if x[0] is not None and x[1] and round(low * 1000) <= round((x[2] or 0) * 1000) <= round((low + width) * 1000) and (not sides or x[1] == ("BUY", "SELL")[sides - 1])]
        means, plans, filled = [], 0, 0
        for f in range(3):
            own = [x for x in inside if x[0] == f]
            done = [x[4] or 0.0 for x in own if x[3]]
            means.append(sum(done) / len(done) if done else 0.0)
            plans, filled = plans + len(own), filled + len(done)
        out = [x[4] or 0.0 for x in inside if x[0] == -1 and x[3]]
        g = got[t]
        assert (g.plans, g.filled, g.holdout_filled) == (plans, filled, len(out))
        assert g.expectancy == pytest.approx(sum(means) / 3) and g.holdout_expectancy == pytest.approx(sum(out) / len(out) if out else 0.0)
        assert (g.value == P.INFEASIBLE) == bool(g.violations)
    assert "low_ess" in got[4].violations or got[4].filled


def test_no_outcomes(spark):
    empty = spark.createDataFrame([], "fold int, side string, score double, filled boolean, ret double")
    asked = spark.createDataFrame([(0, 0.0, 0, 1.0)], "trial int, low double, sides int, width double")
    assert [(r.value, r.violations) for r in P.score_range_trials(P.score_prefixes(empty, F.col("fold")))(asked).collect()] == [(P.INFEASIBLE, ["no_plans"])]
