"""Results that must not depend on the order in which rows arrive."""

from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.operators import kernels as K
from tidemark.plans import QUERIES


def test_percent_rank_turnover_keeps_equal_means(spark, tmp_path):
    """The mean of each supplier ends in half of the last digit kept; sums of doubles fall on either side of it."""
    draw = random.Random(5)
    prices = [round(draw.uniform(900, 100_000), 2) for _ in range(199)]
    prices.append(round(200 * 52_446.48835 - sum(prices), 2))
    rows = [(s, p) for s in range(40) for p in draw.sample(prices, len(prices))]
    pq.write_table(pa.table({"l_suppkey": [r[0] for r in rows], "l_extendedprice": [r[1] for r in rows]}), tmp_path / "lineitem.parquet")
    assert {r["rank"] for r in QUERIES["percent_rank_turnover"](spark, str(tmp_path)).collect()} == {0.0}


def test_allocate_keeps_what_fits_exactly(spark):
    """Half of 820 candidates need all of the cash together."""
    rows = [("a", i, 100.0 + i, 0.05, 0.5) for i in range(820)]
    out = K.allocate(spark.createDataFrame(rows, "batch string, id long, price double, atr_pct double, signal double"), 12_000.0, weight=0.3, legs=3, penalty=2.0)
    assert out.count() == 410


def test_allocate_keeps_what_fits_exactly_however_many(spark):
    """Half of 98,000 candidates need all of the cash together; a running sum of doubles drifts over it by then."""
    rows = spark.range(98_000).selectExpr("'a' AS batch", "id", "100.0D + id AS price", "0.05D AS atr_pct", "0.5D AS signal")
    assert K.allocate(rows, 20_000.0).count() == 49_000


def test_latest_child_pending_is_determined(spark, tmp_path):
    day, found = dt.datetime(2024, 1, 1), set()
    at = {"o_orderkey": [1], "o_custkey": [1], "o_orderpriority": ["x"]}
    for turn in range(2):
        folder = tmp_path / str(turn)
        folder.mkdir()
        lines = [(1, 1, 3.0, "O", day), (1, 1, 5.0, "O", day), (1, 1, 4.0, "F", day)][:: 1 - 2 * turn]
        pq.write_table(pa.table(at), folder / "orders.parquet")
        pq.write_table(pa.table(dict(zip(("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", "l_shipdate"), zip(*lines, strict=True), strict=True))), folder / "lineitem.parquet")
        found |= {tuple(r) for r in QUERIES["latest_child_pending"](spark, str(folder)).collect()}
    assert found == {(1, 1, "x", 1, 5.0)}
