"""Clusters and budgets in bounded blocks: the same as one fold over all rows, and no group in one piece."""

import numpy as np
import pytest

from tidemark.operators import kernels as K


@pytest.mark.parametrize(("block", "least"), [(7, 0.7), (50, 0.9), (1, 0.2)])
def test_clusters_in_rounds(spark, monkeypatch, block, least):
    monkeypatch.setattr(K, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(130, 3))
    v[40:90] = v[3]
    data = [("a" if i < 110 else "b", i, v[i].tolist()) for i in rng.permutation(130).tolist()]
    got = {(r.as_of, r.row_id): (r.cluster, r.similarity) for r in K.leader_clusters(spark.createDataFrame(data, "as_of string, row_id int, vector array<double>").repartition(5), least).collect()}
    assert len(got) == 130
    for key in "ab":
        leaders = []
        for _, i, x in sorted(r for r in data if r[0] == key):
            u = np.array(x) / np.linalg.norm(x)
            hit = next((n for n, y in enumerate(leaders) if y @ u >= least), None)
            if hit is None:
                leaders.append(u)
            assert got[(key, i)] == (len(leaders) - 1 if hit is None else hit, pytest.approx(1.0 if hit is None else leaders[hit] @ u))


def test_a_fold_never_holds_a_whole_date(spark, monkeypatch):
    """One hot date: what a task folds stays at the block's size."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 10)
    plain, sizes = K._held, []
    monkeypatch.setattr(K, "_held", lambda df: (out := plain(df), sizes.append(out.count()) if "leader" in out.columns else None)[0])
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 2)))], "as_of string, row_id int, vector array<double>")
    assert K.leader_clusters(rows, 0.8).count() == 300 and sizes and max(sizes) <= 10


def test_budgets_by_one_pass(spark):
    """Against the two passes in plain Python, over several Arrow batches."""
    rng = np.random.default_rng(7)
    rows = [("xy"[i % 2], i, float(rng.uniform(1, 60)), 0.03, float(rng.uniform(0, 1))) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        df = spark.createDataFrame(rows, "batch string, id long, price double, atr_pct double, signal double")
        got = {r.id: r.budget for r in K.allocate(df, 5_000.0).collect()}
        assert "FlatMapGroupsInPandas" not in K.allocate(df, 5_000.0)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for b in "xy":
        own = [r for r in rows if r[0] == b]
        cap = min(2 * 5_000 / len(own), 0.25 * 5_000)
        c = []
        for _, i, price, atr, signal in sorted(own, key=lambda r: (r[2], r[1])):
            required = 2 * float(np.floor(round(price * (1 - max(0.012, 0.4 * atr)), 6) / 0.01 + 0.5) * 0.01)
            c.append((signal / max(price * atr, 1e-9) * min(1, cap / max(required, 1e-9)) ** 0.5, price, i, min(required, cap)))
        run, kept = 0.0, []
        for x in c:
            run += x[3]
            if run <= 5_000:
                kept.append(x)
        rest, total = 5_000 - sum(x[3] for x in kept), sum(x[0] for x in kept)
        for p, _, i, need in sorted(kept, key=lambda x: (-x[0], x[1], x[2])):
            more = max(0.0, min(cap - need, rest * p / total))
            want[i], rest = need + more, rest - more
    assert got.keys() == want.keys()
    assert [got[i] for i in want] == pytest.approx(list(want.values()), rel=1e-6)
