"""Streams of ``events`` run to their end in a query, with SQL over the same table.

Events arrive in blocks of ten days; every tenth event comes a block late. What a run takes for late is what its
watermark has passed: the latest time that arrived before, less the delay.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import bars as S
from ..streaming import replay as R
from .registry import Tables, query, r6

DAYS = 10


def _events(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return R.late_by(rows, "ts", DAYS, F.col("event_id") % 10 == 0)


def _arrived(delay: str, more: str = "") -> str:
    """``l``: rows with their arrival ``b`` that are not late, by time (``w``: the watermark they met, ``done``: the one after)."""
    return f"""a AS (SELECT event_id, user_id, ts, value, date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) // {DAYS} + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS b FROM events),
    d AS (SELECT * FROM a {more}), n AS (SELECT DISTINCT b FROM d), wm AS (SELECT b, coalesce((SELECT date_trunc('millisecond', max(ts)) - INTERVAL {delay} FROM d WHERE d.b < n.b), TIMESTAMP '1970-01-01') AS w,
        (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {delay} FROM d WHERE d.b <= n.b) AS done FROM n)"""


@query(f"""WITH {_arrived('3 days')}, k AS (SELECT d.*, time_bucket(INTERVAL 5 MINUTE, ts) AS start FROM d JOIN wm USING (b) WHERE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE > w)
    SELECT user_id AS key, start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM k GROUP BY ALL""")
def stream_bars(t: Tables) -> DataFrame:
    """Five-minute bars of the stream, merged into a table as they change; rows whose bar the watermark has passed are left out."""
    build = lambda s: S.tumbling_bars(s, "user_id", "ts", "value", "event_id", late="3 days")
    out = R.run_blocks(_events(t), build, "update", lambda path: S.merge_into(path, ["key", "start"], ["volume"]))
    return out.select("key", F.col("start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "volume")


@query(f"""WITH {_arrived('6 hours', "UNION ALL SELECT event_id, user_id, ts, value, b + 1 FROM a WHERE event_id % 7 = 0")} SELECT DISTINCT event_id, user_id, ts FROM d JOIN wm USING (b) WHERE ts > w""")
def stream_once(t: Tables) -> DataFrame:
    """Every seventh event is delivered again a block later: each is taken once within six hours, and not at all when late."""
    rows = _events(t)
    twice = rows.unionByName(rows.where("event_id % 7 = 0").withColumn("arrival", F.col("arrival") + 1))
    out = R.run_blocks(twice, lambda s: S.once(s, ["event_id"], "ts", "6 hours"))
    return out.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH RECURSIVE {_arrived('1 day')}, o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY b, ts) AS i FROM d JOIN wm USING (b) WHERE ts > w),
    f AS (SELECT user_id, i, ts, ts AS last, true AS kept FROM o WHERE i = 1
        UNION ALL SELECT o.user_id, o.i, o.ts, CASE WHEN o.ts - last >= INTERVAL 1 DAY THEN o.ts ELSE last END, o.ts - last >= INTERVAL 1 DAY FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
    SELECT user_id, ts FROM f WHERE kept""")
def stream_spaced(t: Tables) -> DataFrame:
    """Signals of a user a day apart at least, in order of arrival; a user's state goes when a day has passed."""
    out = R.run_blocks(_events(t).select("user_id", "ts", "arrival"), lambda s: S.spaced_signals(s, "user_id", "ts", 86_400, "1 day"))
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {_arrived('1 hour')}, m AS (SELECT user_id, b, max(ts) AS ts, max_by(value, [epoch_us(ts)::DOUBLE, value]) AS value FROM d JOIN wm USING (b) WHERE ts > w GROUP BY ALL),
    g AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM m), s AS (SELECT * FROM g WHERE known IS NULL OR ts > known),
    e AS (SELECT *, date_trunc('millisecond', ts) AS base, coalesce((SELECT max(done) FROM wm WHERE wm.b < nb), (SELECT max(done) FROM wm)) AS until FROM (SELECT *, lead(b) OVER (PARTITION BY user_id ORDER BY b) AS nb FROM s))
    SELECT user_id, round(value, 6) AS value, ts, 'ACTIVE' AS state, ts AS at FROM e UNION ALL SELECT user_id, round(value, 6), ts, 'GRACE', base + INTERVAL 12 HOUR FROM e WHERE base + INTERVAL 12 HOUR <= until
    UNION ALL SELECT user_id, round(value, 6), ts, 'STALE', base + INTERVAL 18 HOUR FROM e WHERE base + INTERVAL 18 HOUR <= until""")
def stream_snapshot_lives(t: Tables) -> DataFrame:
    """The newest value of each user: active for twelve hours, in grace for six more, then stale, told by timers without new rows."""
    build = lambda s: S.snapshot_lives(s, "user_id", "value", "ts", timedelta(hours=12), timedelta(hours=6), "1 hour")
    out = R.run_blocks(_events(t), build)
    return out.select(F.col("key").alias("user_id"), r6("value").alias("value"), F.col("ts").cast("timestamp_ntz").alias("ts"), "state", F.col("at").cast("timestamp_ntz").alias("at"))
