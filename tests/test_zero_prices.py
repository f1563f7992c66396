"""Bars that close at zero: returns are what floating-point division gives, as in the SQL."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.operators import kernels as K
from tidemark.plans import ORACLES, QUERIES

INF = math.inf
DAY = dt.date(2024, 1, 1)
CLOSES = [1.0, 0.0, 0.0, 2.0]


def _bars(spark):
    rows = [("a", DAY + dt.timedelta(i), c, c, c, c, 1) for i, c in enumerate(CLOSES)]
    return spark.createDataFrame(rows, "key string, day date, open double, high double, low double, close double, volume long")


def _same(got: list, wanted: list) -> bool:
    return len(got) == len(wanted) and all(g == w or (w is not None and g is not None and math.isnan(w) and math.isnan(g)) for g, w in zip(got, wanted, strict=True))


def test_outcomes_after(spark):
    rows = K.outcomes_after(_bars(spark), (1, 2), 1).orderBy("day").collect()
    assert _same([r["t1"] for r in rows], [-1.0, math.nan, INF, None])
    assert _same([r["t2"] for r in rows], [-1.0, INF, None, None])
    assert [r["label"] for r in rows] == ["LOSS", "WIN", "WIN", None]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Events of four users over a month; one of them has prices of zero."""
    at = tmp_path_factory.mktemp("zero")
    price = lambda u, d: 0.0 if u == 3 and d in (6, 7, 15, 26) else 1.0 + (u * 7 + d * 13) % 11
    rows = [(u * 100 + d, dt.datetime(2024, 1, 1 + d, 10 + u), u, ("view", "click", "error")[(u + d) % 3], price(u, d), "{}") for u in range(4) for d in range(30)]
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    pq.write_table(pa.table(dict(zip(names, zip(*rows, strict=True), strict=True))), at / "events.parquet")
    return str(at)


#: Queries that differed from their SQL where a price is zero.
DIFFERED = ["event_memory", "fold_objective", "fold_validation", "missingness", "multiscale_features", "returns_vol_atr"]


@pytest.mark.parametrize("name", DIFFERED)
def test_like_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    text = lambda r: tuple(repr(float(v)) if isinstance(v, (float, Decimal)) else str(v) for v in r)
    wanted = sorted(map(text, want.fetchall()))
    assert sorted(map(text, QUERIES[name](spark, folder).select(columns).collect())) == wanted
    assert any("nan" in r or "inf" in r for r in wanted) or name == "missingness"


@pytest.mark.parametrize("name", ["multiscale_features", "returns_vol_atr"])
def test_a_single_infinite_return_deviates_by_nothing(spark, tmp_path, name):
    """The first return of a key is infinite, as it opens with a price of zero; so the second bar has one return."""
    rows = [(d, dt.datetime(2024, 1, 1 + d, 10), 1, "view", (0.0, 2.0, 3.0)[d], "{}") for d in range(3)]
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    pq.write_table(pa.table(dict(zip(names, zip(*rows, strict=True), strict=True))), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    column = "vol_20" if name == "returns_vol_atr" else "realized_vol_20"
    wanted = [v for (v,) in con.execute(f"SELECT {column} FROM ({ORACLES[name]}) ORDER BY day").fetchall()]
    got = [r[0] for r in QUERIES[name](spark, str(tmp_path)).orderBy("day").select(column).collect()]
    assert _same(got, wanted) and wanted[1] == 0.0
