"""As-of joins in pieces of time give what one sort of a whole key gives, and no piece holds a hot key."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.operators import research as S

T0 = datetime.datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + datetime.timedelta(minutes=n)


def sides(seed, n=400):
    r = random.Random(seed)
    key = lambda i: "hot" if i % 3 else r.choice(("a", "b", None))
    left = [(i, key(i), at(r.choice((None, *range(200))) if i % 50 == 0 else r.randrange(200))) for i in range(n)]
    right = [(key(i), at(None if i % 60 == 59 else r.randrange(-5, 200)), r.randrange(5), i if i % 7 else None) for i in range(n)]
    return left, right


@pytest.mark.parametrize(("strict", "pieces"), [(False, 8), (True, 8), (False, 200), (True, 3)])
def test_pieces_change_nothing(spark, strict, pieces):
    left, right = sides(pieces)
    a, b = spark.createDataFrame(left, "i int, k string, t timestamp").repartition(3), spark.createDataFrame(right, "k string, u timestamp, x int, v int")
    got, want = ({r.i: (r.asof_x, r.asof_v) for r in R.asof(a, b, ["k"], "t", "u", ["x", "v"], ["x", "v"], strict, p).collect()} for p in (pieces, 1))
    assert got == want and len(got) == len(left)


def test_no_piece_holds_a_hot_key(spark):
    n = 20_000
    a = spark.range(n).select(F.lit("one").alias("k"), F.col("id").alias("i"), (F.col("id") * 2).alias("t"))
    b = spark.range(n).select(F.lit("one").alias("k"), (F.col("id") * 2 + 1).alias("u"), F.col("id").alias("x"))
    out = R.asof(a, b, ["k"], "t", "u", ["x"], pieces=16)
    assert out.where("asof_x IS DISTINCT FROM CASE WHEN i > 0 THEN i - 1 END").count() == 0
    sizes = R._asof_in_pieces(
        a.select("k", F.struct("i").alias("__row"), F.col("t").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("struct<x:bigint>").alias("__v")), ["k"], [], 16
    ).groupBy("__piece").count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * n / 16


def test_empty_sides(spark):
    a, b = spark.createDataFrame([(1, "a", at(1))], "i int, k string, t timestamp"), spark.createDataFrame([], "k string, u timestamp, x int")
    assert [r.asof_x for r in R.asof(a, b, ["k"], "t", "u", ["x"], pieces=8).collect()] == [None]
    assert R.asof(a.limit(0), b, ["k"], "t", "u", ["x"], pieces=8).collect() == []


def test_violations_by_cause(spark):
    anchors = spark.createDataFrame([(1, at(10)), (2, at(20)), (3, at(30)), (4, at(40))], "key int, anchor timestamp")
    observed = spark.createDataFrame([("s", at(15), at(25)), ("s", at(28), None), ("s", at(35), at(40)), ("other", at(0), at(0))], "name string, observed timestamp, published timestamp")
    pairs = S.order_violations(anchors, observed, ["s", "gone"])
    assert {(r.key, r.cause) for r in pairs.where("name = 's'").collect()} == {(1, "NO_SOURCE"), (2, "LOOK_AHEAD"), (3, "UNDATED"), (4, None)}
    report = {(r.name, r.cause): (r.rows, r.keys, r.share, r.worst_hours) for r in S.violation_report(pairs).collect()}
    assert report[("s", "LOOK_AHEAD")] == (1, 1, 0.25, pytest.approx(5 / 60)) and report[("gone", "NO_SOURCE")] == (4, 4, 1.0, None) and ("s", "OK") in report
