import datetime

from pyspark.sql import functions as F

from tidemark.streaming import bars as S
from tidemark.streaming import replay as R


def ticks(spark, sf, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(src)
    table = spark.read.parquet(src)
    return table, spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(src)


def landed(query, path, n=None):
    query.awaitTermination()
    assert query.exception() is None


def test_streamed_bars_equal_batch_bars(spark, sf, tmp_path):
    table, stream = ticks(spark, sf, tmp_path)
    args = ("user_id", "ts", "value", "event_id")
    q = S.tumbling_bars(stream, *args, late="60 days").writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in S.tumbling_bars(table, *args).collect()}
    assert {tuple(r) for r in spark.table("bars").collect()} == want and want
    assert S.tumbling_bars(table, *args, every="10 minutes", slide="5 minutes").agg(F.sum("volume")).first()[0] == 2 * table.count()
    assert S.sessions(table, "user_id", "ts").agg(F.sum("n")).first()[0] == table.count()


def test_merge_sink_keeps_newest_and_survives_replay(spark, sf, tmp_path):
    table, stream = ticks(spark, sf, tmp_path)
    path = str(tmp_path / "out")
    sink = S.merge_into(path, ["user_id"], ["ts", "event_id"])
    q = S.land(stream.select("user_id", "ts", "event_id"), str(tmp_path / "ck"), sink)
    q.awaitTermination()
    want = {r.user_id: r.e for r in table.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    got = {r.user_id: r.event_id for r in spark.read.parquet(path).collect()}
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    assert got == want and files
    sink(table.where("user_id = 1").select("user_id", "ts", "event_id"), 9)  # touches one partition
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    assert len(set(files.items()) - set(after.items())) == 1 and {r.user_id: r.event_id for r in spark.read.parquet(path).collect()} == want
    again = S.land(stream.select("user_id", "ts", "event_id"), str(tmp_path / "ck"), sink)
    again.awaitTermination()
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")} == after


def test_snapshot_states(spark):
    t = datetime.datetime(2024, 1, 1, 12)
    rows = [("a", 1.0, t), ("a", 0.5, t - datetime.timedelta(hours=1)), ("b", 2.0, t - datetime.timedelta(minutes=80)), ("c", 3.0, t - datetime.timedelta(hours=3)), ("d", 4.0, t + datetime.timedelta(hours=1))]
    got = {r.key: (r.value, r.state) for r in S.snapshot_state(spark.createDataFrame(rows, "key string, value double, ts timestamp"), "key", F.lit(t)).collect()}
    assert got == {"a": (1.0, "ACTIVE"), "b": (2.0, "GRACE"), "c": (3.0, "STALE")}


def test_spacing_and_dedup(spark, sf, tmp_path):
    table, stream = ticks(spark, sf, tmp_path)
    q = S.spaced_signals(stream.where("event_type = 'view'").select("user_id", "ts"), "user_id", "ts", 86_400).writeStream.format("memory").queryName("spaced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("spaced").count() < table.where("event_type = 'view'").count()
    q = S.once(stream, ["event_id"], "ts", "60 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == table.count()


def at(h, minute=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=minute)


def test_lives_end_without_new_rows_of_the_key(spark):
    """a is renewed in time and then ends; b's newest of a batch counts; c is older than the known; null times change nothing."""
    rows = [("a", 1.0, at(0), 0), ("b", 1.0, at(0), 0), ("b", 2.0, at(1), 0), ("c", 5.0, at(2), 0), ("n", 1.0, None, 0), ("a", 2.0, at(3), 1), ("c", 6.0, at(1), 1), ("z", 0.0, at(7), 1), (None, 3.0, at(7), 2), ("z", None, at(30), 2)]
    df = spark.createDataFrame(rows, "key string, value double, ts timestamp, arrival int")
    build = lambda s: S.snapshot_lives(s, "key", "value", "ts", datetime.timedelta(hours=4), datetime.timedelta(hours=2), "2 hours")
    got = sorted(((r.key, r.value, r.state, r.at) for r in R.run_blocks(df, build, store=R.ROCKS).collect()), key=str)
    want = [("a", 1.0, "ACTIVE", at(0)), ("a", 2.0, "ACTIVE", at(3)), ("a", 2.0, "GRACE", at(7)), ("a", 2.0, "STALE", at(9)), ("b", 2.0, "ACTIVE", at(1)), ("b", 2.0, "GRACE", at(5)), ("b", 2.0, "STALE", at(7))]
    want += [("c", 5.0, "ACTIVE", at(2)), ("c", 5.0, "GRACE", at(6)), ("c", 5.0, "STALE", at(8)), (None, 3.0, "ACTIVE", at(7)), (None, 3.0, "GRACE", at(11)), (None, 3.0, "STALE", at(13)), ("z", 0.0, "ACTIVE", at(7)), ("z", None, "ACTIVE", at(30))]
    assert got == sorted(want, key=str)


def test_spaced_state_expires_and_late_rows_go(spark):
    rows = [(1, at(0), 0), (1, at(0, 30), 0), (1, at(2), 0), (2, at(5), 0), (1, at(1), 1), (1, at(6), 1), (1, at(2, 30), 1)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, arrival int")
    got = sorted((r.user_id, r.ts) for r in R.run_blocks(df, lambda s: S.spaced_signals(s, "user_id", "ts", 3_600, "3 hours")).collect())
    assert got == [(1, at(0)), (1, at(2)), (1, at(6)), (2, at(5))]


def test_streams_of_nothing(spark):
    none = spark.createDataFrame([], "user_id long, ts timestamp, value double, arrival int")
    assert R.run_blocks(none, lambda s: S.once(s, ["user_id"], "ts")).collect() == []
    assert R.run_blocks(none, lambda s: S.spaced_signals(s.select("user_id", "ts"), "user_id", "ts", 60)).columns == ["user_id", "ts"]


def test_merge_of_a_batch_twice_and_of_null_keys(spark, tmp_path):
    sink = S.merge_into(str(tmp_path / "t"), ["k"], ["n"], parts=3)
    first = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 5)], "k int, n int")
    second = spark.createDataFrame([(2, 7), (3, 1), (None, 6)], "k int, n int")
    for number, batch in enumerate((first, second, second)):
        sink(batch, min(number, 1))
    sink(first.limit(0), 2)
    assert sorted(((r.k, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()), key=str) == [(1, 2), (2, 7), (3, 1), (None, 6)]


def test_keys_of_a_stream_share_calls(spark, monkeypatch):
    """Many keys in few groups: keys in one group stay apart, and long keys keep all their digits."""
    monkeypatch.setattr(S, "GROUPS", 2)
    keys = [(1 << 60) + i for i in range(9)] + [None]
    rows = [(k, float(i), at(i), 0) for i, k in enumerate(keys)] + [(k, float(i), at(i + 30), 1) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "user_id long, value double, ts timestamp, arrival int")
    spaced = lambda s: S.spaced_signals(s.select("user_id", "ts"), "user_id", "ts", 40 * 3_600, "60 days")
    lives = lambda s: S.snapshot_lives(s, "user_id", "value", "ts", datetime.timedelta(hours=20), datetime.timedelta(hours=1), "60 days")
    assert sorted(((r.user_id, r.ts) for r in R.run_blocks(df, spaced).collect()), key=str) == sorted(((k, at(i)) for i, k in enumerate(keys)), key=str)
    want = [(k, float(i), "ACTIVE", at(i + h)) for i, k in enumerate(keys) for h in (0, 30)]
    assert sorted(((r.key, r.value, r.state, r.at) for r in R.run_blocks(df, lives).collect()), key=str) == sorted(want, key=str)
