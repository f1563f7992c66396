"""Bars and sessions of a tick stream, and ways to land them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import held


def tumbling_bars(ticks: DataFrame, key: str, ts: str, price: str, tie: str, every: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Bars of a stream (or table), final once the watermark has passed their end."""
    at = F.struct(ts, tie)
    window = F.window(ts, every, slide) if slide else F.window(ts, every)
    marked = ticks.withWatermark(ts, late) if ticks.isStreaming else ticks
    out = marked.groupBy(F.col(key).alias("key"), window.alias("w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume")
    )
    return out.select("key", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, key: str, ts: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    marked = ticks.withWatermark(ts, late) if ticks.isStreaming else ticks
    out = marked.groupBy(F.col(key).alias("key"), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def once(ticks: DataFrame, keys: Sequence[str], ts: str, within: str = "6 hours") -> DataFrame:
    """Rows whose key has not been seen within the time."""
    return ticks.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def merge_into(path: str, keys: Sequence[str], order: Sequence[str], parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the newest row of each key in a table of ``parts`` partitions by hash of the key.

    The newest is the largest in ``order``, nulls last, of equal ones the one that came later. Only partitions that a
    batch touches are read and overwritten; what they become is written aside first. A batch that is replayed, also
    after a crash half way, changes nothing more. Null keys are keys.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order_by = [F.col(c).desc_nulls_last() for c in order]

        def newest(rows: DataFrame, *then) -> DataFrame:
            return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by, *then))).where("__n = 1").drop("__n")

        new = held(newest(batch).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")))
        touched = [r[0] for r in new.select("part").distinct().collect()]  # `parts` at most
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            old = spark.read.schema(new.schema).parquet(path).where(F.col("part").isin(touched))
            both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
            new = held(newest(both, F.desc("__new")).drop("__new"))
        if touched:
            new.repartition("part").write.mode("overwrite").partitionBy("part").option("partitionOverwriteMode", "dynamic").parquet(path)

    return write


def land(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Take all that is new since the checkpoint, then stop."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_state(snapshots: DataFrame, key: str, as_of, ttl: str = "1 hour", grace: str = "30 minutes") -> DataFrame:
    """The newest snapshot of each key at ``as_of`` and whether it is active, in grace, or stale."""
    newest = snapshots.where(F.col("ts") <= as_of).groupBy(key).agg(F.max_by(F.struct("value", "ts"), "ts").alias("s")).select(key, "s.value", "s.ts")
    expiry = F.col("ts") + F.expr(f"INTERVAL {ttl}")
    return newest.withColumn("state", F.when(expiry >= as_of, "ACTIVE").when(expiry + F.expr(f"INTERVAL {grace}") >= as_of, "GRACE").otherwise("STALE"))


#: Groups into which the keys of a stateful stream are dealt: a call and a stored state a group and batch, not a key.
GROUPS = 1_024


def _dealt(stream: DataFrame, key: str) -> tuple[DataFrame, str]:
    """The stream with ``__group`` and its key as text, which holds every key exactly, and the key's type."""
    return stream.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")).withColumn(key, F.col(key).cast("string")), dict(stream.dtypes)[key]


def _micros(times: pd.Series) -> list[int]:
    return times.to_numpy("datetime64[us]").astype("int64").tolist()


def spaced_signals(stream: DataFrame, key: str, ts: str, gap_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Signals of a key that come at least ``gap_seconds`` after the one kept before, in order of time within a batch.

    Rows that are not after the watermark are dropped. The state of a key goes once the watermark has passed the gap: what comes then is kept anyhow.
    """
    gap = gap_seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = [] if state.hasTimedOut else sorted(((at, name) for df in batches for at, name in zip(_micros(df[ts]), df[key], strict=True)), key=lambda r: r[0])
        kept = []
        for at, name in rows:
            before = last.get(name)
            if at > mark * 1_000 and (before is None or at - before >= gap):
                kept.append((name, at))
                last[name] = at
        last = {name: at for name, at in last.items() if (at + gap) // 1_000 >= mark}
        if last:
            state.update((list(last), list(last.values())))
            state.setTimeoutTimestamp(max((min(last.values()) + gap) // 1_000, mark + 1))
        elif state.exists:
            state.remove()
        if kept:
            yield pd.DataFrame({key: [name for name, _ in kept], ts: pd.to_datetime([at for _, at in kept], unit="us")})

    rows, kind = _dealt(stream.withWatermark(ts, late), key)
    out = rows.groupBy("__group").applyInPandasWithState(step, f"{key} string, {ts} timestamp", "keys array<string>, lasts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn(key, F.col(key).cast(kind))


def snapshot_lives(snapshots: DataFrame, key: str, value: str, ts: str, ttl: timedelta, grace: timedelta, late: str = "0 seconds") -> DataFrame:
    """``key, value, ts, state, at``: a row when a key gets a newer snapshot (ACTIVE), when its life ends (GRACE) and when its grace ends (STALE).

    The ends are told by timers once the watermark has passed them, without new rows of the key; a stale snapshot's
    state is dropped. Of several snapshots in a batch the newest counts, of equal times the largest value; older ones
    than the known, and null times, change nothing. A group's timer is set for the first end of any of its keys.
    """
    life, extra = int(ttl.total_seconds() * 1000), int(grace.total_seconds() * 1000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        known = {name: rest for name, *rest in zip(*state.get, strict=True)} if state.exists else {}  # value, micros, due, in grace
        newest: dict = {}
        for df in () if state.hasTimedOut else batches:
            df = df[df["ts"].notna()]
            for name, at, v in zip(df["key"], _micros(df["ts"]), df["value"].tolist(), strict=True):
                found = (at, -math.inf if pd.isna(v) else v, None if pd.isna(v) else v)
                if name not in newest or found[:2] > newest[name][:2]:
                    newest[name] = found
        out = []
        for name, (at, _, v) in newest.items():
            if name not in known or at > known[name][1]:
                known[name] = [v, at, at // 1_000 + life, False]
                out.append((name, v, at, "ACTIVE", at))
        for name in [name for name, rest in known.items() if rest[2] <= mark]:
            v, at, due, ending = known[name]
            if not ending:
                out.append((name, v, at, "GRACE", due * 1_000))
                due += extra
                if due > mark:
                    known[name] = [v, at, due, True]
                    continue
            del known[name]
            out.append((name, v, at, "STALE", due * 1_000))
        if known:
            state.update((list(known), *map(list, zip(*known.values(), strict=True))))
            state.setTimeoutTimestamp(min(rest[2] for rest in known.values()) - 1)  # fires when the watermark is past it
        elif state.exists:
            state.remove()
        if out:
            rows = pd.DataFrame(out, columns=["key", "value", "ts", "state", "at"])
            yield rows.assign(value=rows["value"].astype("Float64"), ts=pd.to_datetime(rows["ts"], unit="us"), at=pd.to_datetime(rows["at"], unit="us"))

    rows = snapshots.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), F.col(ts).alias("ts")).withWatermark("ts", late)
    rows, kind = _dealt(rows, "key")
    schema, stored = "key string, value double, ts timestamp, state string, at timestamp", "keys array<string>, newest array<double>, times array<long>, due array<long>, ending array<boolean>"
    out = rows.groupBy("__group").applyInPandasWithState(step, schema, stored, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("key", F.col("key").cast(kind))
