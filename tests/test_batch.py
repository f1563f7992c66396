"""A job that is run again: what it writes, and what counts after changes, losses and a run that broke off."""

import datetime
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import batch as J

DAY = datetime.date(2024, 1, 1)
SCHEMA = "key long, day date, x double"


def rows(*more):
    return [(k, DAY + datetime.timedelta(d), float(k * 10 + d)) for k in range(4) for d in range(3)] + list(more)


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def job(spark, root, calls=None):
    def totals(current, batch):
        if calls is not None:
            calls.append(sorted({r.key for r in current.select("key").distinct().collect()}, key=str))
        return current.groupBy("key").agg(F.sum("x").alias("total"))

    def ranks(current, batch):
        larger = batch.everything("totals").select(F.col("total").alias("other"))
        return batch.new_totals.join(larger, F.col("other") > F.col("total"), "left").groupBy("key").agg(F.count("other").alias("above"))

    return J.Batch(spark, str(root), {"totals": totals, "ranks": ranks})


def held(j):
    return {r.key: (r.total, r.run) for r in j.table("totals").collect()}


def test_only_changed_keys_are_done_again(spark, tmp_path):
    calls = []
    j = job(spark, tmp_path, calls)
    assert j.table("totals") is None and j.run(spark.createDataFrame(rows(), SCHEMA)) == {"changed": 4, "gone": 0}
    first = files(tmp_path)
    assert j.run(spark.createDataFrame(rows()[::-1], SCHEMA).repartition(5)) == {"changed": 0, "gone": 0} and files(tmp_path) == first and len(calls) == 1
    changed = [(k, d, x + 1 if (k, d) == (2, DAY) else x) for k, d, x in rows()]
    assert j.run(spark.createDataFrame(changed, SCHEMA)) == {"changed": 1, "gone": 0} and calls[1] == [2]
    assert {f: t for f, t in files(tmp_path).items() if f in first} == first
    assert held(j) == {0: (3.0, 0), 1: (33.0, 0), 2: (64.0, 1), 3: (93.0, 0)}
    assert {r.key: (r.above, r.run) for r in j.table("ranks").collect()} == {0: (3, 0), 1: (2, 0), 2: (1, 1), 3: (0, 0)}


def test_new_gone_repeated_and_null_keys(spark, tmp_path):
    j = job(spark, tmp_path)
    j.run(spark.createDataFrame(rows(), SCHEMA))
    left = [r for r in rows((7, DAY, 1.0), (None, DAY, 5.0)) if r[0] != 0]
    assert j.run(spark.createDataFrame(left, SCHEMA)) == {"changed": 2, "gone": 1}
    assert held(j) == {1: (33.0, 0), 2: (63.0, 0), 3: (93.0, 0), 7: (1.0, 1), None: (5.0, 1)}
    assert j.run(spark.createDataFrame([*left, (None, DAY, 5.0)], SCHEMA)) == {"changed": 1, "gone": 0} and held(j)[None] == (10.0, 2)
    assert j.run(spark.createDataFrame(rows(), SCHEMA)) == {"changed": 1, "gone": 2} and held(j) == {0: (3.0, 3), 1: (33.0, 0), 2: (63.0, 0), 3: (93.0, 0)}
    assert j.run(spark.createDataFrame([], SCHEMA)) == {"changed": 0, "gone": 4} and held(j) == {}


def test_a_run_that_broke_off_is_done_again(spark, tmp_path):
    j = job(spark, tmp_path)
    j.run(spark.createDataFrame(rows(), SCHEMA))
    broken = job(spark, tmp_path)
    broken.stages["ranks"] = lambda current, batch: 1 / 0
    new = spark.createDataFrame(rows((1, DAY, 100.0)), SCHEMA)
    with pytest.raises(ZeroDivisionError):
        broken.run(new)
    assert held(j)[1] == (33.0, 0)  # what counts is as before
    assert j.run(new) == {"changed": 1, "gone": 0} and held(j)[1] == (133.0, 1)
    shutil.rmtree(tmp_path / "keys" / "run=1")  # lost before it was logged
    assert held(j)[1] == (33.0, 0) and j.run(new) == {"changed": 1, "gone": 0} and held(j)[1] == (133.0, 1)
