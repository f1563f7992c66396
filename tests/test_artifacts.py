"""Frozen artifacts: what names them, what is refused, and that a second fit finds the first."""

import datetime
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.canonical import row_hash, spec_hash, table_hash
from tidemark.operators import artifacts as A

DAY = datetime.date(2024, 1, 1)
SCHEMA = "key long, day date, outcome_day date, state int, score double, ret double, f1 double, f2 double"


def day(n):
    return DAY + datetime.timedelta(n)


def rows(n=200, seed=1):
    r = random.Random(seed)
    return [(i, day(i % 20), day(i % 20 + 2), i % 3, r.random(), r.gauss(0, 1), r.gauss(5, 2), None if i % 17 == 0 else r.random()) for i in range(n)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def fit(spark, root, df, end=10, test=14):
    return A.fit(str(root), {"horizon": 2}, df, ["f1", "f2"], day(end), day(test))


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names}


def test_spec_hash_is_of_sorted_json():
    spec = {"b": 1, "a": "é", "c": [True, None]}
    assert spec_hash(spec) == hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    assert spec_hash({"x": 0.1 + 0.2}) == spec_hash({"x": 0.3}) != spec_hash({"x": 0.30001}) and spec_hash({"x": -0.0}) == spec_hash({"x": 0.0})


def test_table_hash_of_any_order(spark):
    df = frame(spark)
    base = table_hash(df)
    assert base == table_hash(df.repartition(7).orderBy(F.rand(3))) == table_hash(df.select(*reversed(df.columns)))
    assert len({base, table_hash(df.union(df)), table_hash(df.limit(199)), table_hash(df.withColumn("f1", F.col("f1") + 1e-7)), table_hash(df.withColumnRenamed("f1", "g")), table_hash(df.limit(0))}) == 6
    assert table_hash(df.withColumn("f1", F.col("f1") + 1e-11 * (F.round("f1", 8) - F.col("f1")))) == base


def test_canonical_rows(spark):
    df = spark.sql("""SELECT named_struct('b', 1.5D, 'a', 'q"x') AS s, array(1, NULL) AS l, map('z', 1, 'a', 2) AS m, -0.0D AS d, CAST(NULL AS STRING) AS n, DATE '2024-01-02' AS t, true AS y""")
    want = '{"d":0.00000000,"l":[1,null],"m":{"a":2,"z":1},"n":null,"s":{"a":"q\\"x","b":1.50000000},"t":"2024-01-02","y":true}'
    assert df.select(row_hash(df)).first()[0] == hashlib.sha256(want.encode()).hexdigest()


def test_fit_is_stored_once_and_scores(spark, tmp_path):
    df = frame(spark)
    name = fit(spark, tmp_path, df)
    before = files(tmp_path)
    assert fit(spark, tmp_path, df.repartition(5)) == name and files(tmp_path) == before
    assert fit(spark, tmp_path, df.where("state < 2")) != name
    got = A.score(spark, str(tmp_path), name, df.where(F.col("day") >= F.lit(day(14)))).collect()
    train = [r for r in rows() if r[2] <= day(10)]
    n = len(train)
    value = lambda r, i: r[i] or 0.0
    mean = [sum(value(r, i) for r in train) / n for i in (6, 7)]
    std = [(sum((value(r, i) - m) ** 2 for r in train) / n) ** 0.5 for i, m in zip((6, 7), mean, strict=True)]
    z = lambda r: [(value(r, i) - m) / s for i, m, s in zip((6, 7), mean, std, strict=True)]
    protos = {s: [sum(z(r)[j] for r in train if r[3] == s) / sum(r[3] == s for r in train) for j in (0, 1)] for s in range(3)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    by_key = {r[0]: r for r in rows()}
    assert len(got) == sum(r[1] >= day(14) for r in rows())
    for g in got:
        own = z(by_key[g.key])
        best = max(protos, key=lambda s: (cos(own, protos[s]), -s))
        assert g.z == pytest.approx(own) and g.match == best and g.similarity == pytest.approx(cos(own, protos[best])) and 0 < g.probability < 1


def test_mixed_days_are_refused(spark, tmp_path):
    df = frame(spark)
    with pytest.raises(A.ArtifactError, match="outcomes run to"):
        fit(spark, tmp_path, df, end=10, test=10)
    with pytest.raises(A.ArtifactError, match="no training rows"):
        fit(spark, tmp_path, df, end=-5)
    name = fit(spark, tmp_path, df, end=10, test=14)
    for first in (8, 10):  # a training day, and the last outcome's day, on the first day of the test
        with pytest.raises(A.ArtifactError, match="the test begins"):
            A.score(spark, str(tmp_path), name, df.where(F.col("day") >= F.lit(day(first))))
    assert A.score(spark, str(tmp_path), name, df.where(F.col("day") >= F.lit(day(11)))).count() > 0
    assert A.score(spark, str(tmp_path), name, df.where("false")).count() == 0


@pytest.mark.parametrize("table", [*A.TABLES, "manifest"])
def test_changed_artifacts_are_refused(spark, tmp_path, table):
    name = fit(spark, tmp_path, frame(spark))
    path = f"{tmp_path}/{name}/{table}"
    changed = spark.createDataFrame(spark.read.parquet(path).collect(), spark.read.parquet(path).schema)
    column = {"scaler": "mean", "prototypes": "mean_ret", "calibration": "slope", "manifest": "rows"}[table]
    changed.withColumn(column, F.col(column) + 1).write.mode("overwrite").parquet(path)
    with pytest.raises(A.ArtifactError, match="has changed"):
        A.load(spark, str(tmp_path), name, None)
    with pytest.raises(A.ArtifactError, match="no artifact"):
        A.load(spark, str(tmp_path), "0" * 64, None)
