"""Weighted quantiles in ranges of values, against one sort of each key."""

import random

from tidemark.operators import statistics as A


def test_ranges_change_nothing(spark):
    """A hot key, equal values, null keys, values and weights: the same as a plain pass over each key; whole weights, so sums are exact."""
    r = random.Random(1)
    rows = [("hot" if i % 3 else r.choice(("a", "b", None)), None if i % 31 == 0 else r.randrange(60) / 4, None if i % 29 == 0 else float(r.randrange(5))) for i in range(900)] + [("zero", 1.0, 0.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double").repartition(5)
    for ranges in (1, 7, 64):
        got = {x.k: (x.q10, x.q50, x.q90) for x in A.weighted_quantiles(df, ["k"], "x", "w", [0.1, 0.5, 0.9], ranges=ranges).collect()}
        want = {}
        for k in {x[0] for x in rows}:
            own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0))
            total, run, found = max(sum(x[2] or 0 for x in own), 1e-12), 0.0, [None] * 3
            for j, (_, x, w) in enumerate(own):
                run += w or 0
                last = j + 1 == len(own) or own[j + 1][1] != x
                for i, q in enumerate((0.1, 0.5, 0.9)):
                    if last and x is not None and found[i] is None and run / total >= q:
                        found[i] = x
            want[k] = tuple(found)
        assert got == want
    assert A.weighted_quantiles(df.limit(0), ["k"], "x", "w", [0.5]).collect() == []
