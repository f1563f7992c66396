"""The research panel asks about every bar of every user, held against plain Python."""

import datetime
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import research as S
from tidemark.plans import research as R
from tidemark.plans.registry import Tables


@pytest.fixture(scope="module")
def panel(spark, sf):
    """Similarity of each bar to each cluster of its date's memory: ``(as_of, q, cluster)``."""
    t = Tables(spark, sf)
    events = R._events(t).withColumn("row_id", F.xxhash64("key", "day")).collect()
    bars = S.bar_features(R._bars(t), (1, 3, 5)).collect()
    names, out = sorted(R.FEATURES), {}
    for as_of in sorted({b.day + datetime.timedelta(1) for b in bars}):
        memory = sorted((e for e in events if e.end_day < as_of), key=lambda e: e.row_id)
        if not memory:
            continue
        x = np.array([[e[c] for c in names] for e in memory])
        mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-8) if len(x) > 1 else np.ones(len(names))
        unit = lambda v: v / n if (n := np.linalg.norm(v)) > 0 else v * 0
        leaders, members = [], defaultdict(list)
        for e, v in zip(memory, (x - mean) / std, strict=True):
            hit = next((i for i, u in enumerate(leaders) if u @ unit(v) >= 0.9), None)
            if hit is None:
                hit = len(leaders)
                leaders.append(unit(v))
            members[hit].append((e.quality, e.relative_volume, -e.row_id, v))
        for b in bars:
            if b.day + datetime.timedelta(1) == as_of:
                q = unit((np.array([b[c] for c in names]) - mean) / std)
                out |= {(as_of, b.key, c): float(q @ unit(max(m, key=lambda z: z[:3])[3])) for c, m in members.items()}
    return out


def test_scores_cover_every_user_and_date(spark, sf, panel):
    got = {(r.as_of, r.q, r.cluster): r.similarity for r in plans.QUERIES["prototype_scores"](spark, sf).collect()}
    assert len({k[0] for k in got}) > 3 and max(k[1] for k in got) >= 40 or max(k[1] for k in panel) < 40
    assert got.keys() == panel.keys()
    assert [got[k] for k in panel] == pytest.approx(list(panel.values()), abs=2e-6)


@pytest.mark.parametrize("name", ["decision_surface", "quote_policy"])
def test_every_bar_has_a_decision(spark, sf, panel, name):
    got = [(r.as_of, r.q) for r in plans.QUERIES[name](spark, sf).select("as_of", "q").collect()]
    assert len(got) == len(set(got)) and set(got) == {k[:2] for k in panel}


def test_every_date_has_prototypes(spark, sf, panel):
    got = {(r.as_of, r.cluster) for r in plans.QUERIES["state_prototypes"](spark, sf).collect()}
    assert got >= {(a, c) for a, _, c in panel} and len({a for a, _ in got}) > 3
