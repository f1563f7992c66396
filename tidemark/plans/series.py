"""Time-series queries over bars made from ``events``: the key is the user or the event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, dead_zone_sign, guarded_div, logistic
from ..operators import kernels as K
from ..operators import open_plans as O
from ..operators import rebalance as Z
from ..operators import relational as R
from ..operators import windows as W
from .registry import Tables, query, r6

BARS = """bars AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY ALL)"""
TYPE_BARS = BARS.replace("user_id AS key", "event_type AS key")


def _bars(t: Tables, key: str = "user_id") -> DataFrame:
    return W.daily_bars(t.events.select(key, "ts", "value", "event_id"), key, "ts", "value", "event_id")


@query(f"WITH {BARS} SELECT * FROM bars")
def daily_bars(t: Tables) -> DataFrame:
    return _bars(t)


@query("""SELECT user_id AS key, time_bucket(INTERVAL 5 MINUTE, ts) AS start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY ALL""")
def resample_5min(t: Tables) -> DataFrame:
    return W.resample(t.events, "user_id", "ts", "value", "event_id")


@query(f"""WITH {BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 3) OVER w - 1 AS ret_3, close / lag(close, 5) OVER w - 1 AS ret_5,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY key ORDER BY day))
    SELECT key, day, round(ret_1, 6) AS ret_1, round(ret_3, 6) AS ret_3, round(ret_5, 6) AS ret_5, round(stddev_pop(ret_1) OVER (PARTITION BY key ORDER BY day ROWS 19 PRECEDING), 6) AS vol_20,
    round(avg(tr) OVER (PARTITION BY key ORDER BY day ROWS 13 PRECEDING), 6) AS atr_14 FROM r""")
def returns_vol_atr(t: Tables) -> DataFrame:
    out = W.path_features(_bars(t))
    return out.select("key", "day", *(r6(c).alias(c) for c in ("ret_1", "ret_3", "ret_5", "vol_20", "atr_14")))


@query(f"""WITH {BARS}, f AS (SELECT a.key, a.day, b.day AS d, b.close, max(b.close) OVER (PARTITION BY a.key, a.day ORDER BY b.day) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS n FROM bars) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS n FROM bars) b ON a.key = b.key AND b.n BETWEEN a.n - 19 AND a.n)
    SELECT key, day, round(least(0, min(close / peak - 1)), 6) AS drawdown_20 FROM f GROUP BY ALL""")
def drawdown_20(t: Tables) -> DataFrame:
    return W.path_features(_bars(t)).select("key", "day", r6("drawdown_20").alias("drawdown_20"))


@query(f"""WITH {TYPE_BARS}, g AS (SELECT *, coalesce(close - lag(close) OVER w, 0) AS m FROM bars WINDOW w AS (PARTITION BY key ORDER BY day)),
    s AS (SELECT *, count(*) OVER w14 AS n14, avg(CASE WHEN m > 0 THEN m ELSE 0 END) OVER w14 AS up, avg(CASE WHEN m < 0 THEN -m ELSE 0 END) OVER w14 AS down, count(*) OVER w20 AS n20, avg(close) OVER w20 AS mid, stddev_samp(close) OVER w20 AS sd,
          avg(close) OVER (PARTITION BY key ORDER BY day ROWS 49 PRECEDING) AS ma_50, volume / avg(volume) OVER w20 AS vr FROM g
          WINDOW w14 AS (PARTITION BY key ORDER BY day ROWS 13 PRECEDING), w20 AS (PARTITION BY key ORDER BY day ROWS 19 PRECEDING))
    SELECT key, day, round(mid, 6) AS ma_20, round(ma_50, 6) AS ma_50, round(CASE WHEN n14 < 14 THEN NULL WHEN down = 0 THEN CASE WHEN up > 0 THEN 100 END ELSE 100 - 100 / (1 + up / down) END, 6) AS rsi,
    CASE WHEN n20 >= 20 THEN round(mid + 2 * sd, 6) END AS bb_upper, CASE WHEN n20 >= 20 THEN round(mid - 2 * sd, 6) END AS bb_lower, round(vr, 6) AS volume_ratio FROM s""")
def rsi_bollinger(t: Tables) -> DataFrame:
    out = W.indicators(_bars(t, "event_type"))
    return out.select("key", "day", *(r6(c).alias(c) for c in ("ma_20", "ma_50", "rsi", "bb_upper", "bb_lower", "volume_ratio")))


def _ewm_sql(span: int) -> str:
    a = 2.0 / (span + 1)
    return f"CASE WHEN count(*) >= {span} THEN sum(b.close * pow({1 - a!r}, a.n - b.n)) / sum(pow({1 - a!r}, a.n - b.n)) END"


@query(f"""WITH {TYPE_BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS n FROM bars)
    SELECT a.key, a.day, round({_ewm_sql(12)}, 6) AS ema_12, round({_ewm_sql(26)}, 6) AS ema_26 FROM r a JOIN r b ON a.key = b.key AND b.n <= a.n GROUP BY a.key, a.day""")
def ema_pair(t: Tables) -> DataFrame:
    out = W.indicators(_bars(t, "event_type"))
    return out.select("key", "day", r6("ema_12").alias("ema_12"), r6("ema_26").alias("ema_26"))


def _ewm_of(x: str, span: int, a: str = "a", b: str = "b") -> str:
    decay = 1 - 2.0 / (span + 1)
    return f"CASE WHEN count({b}.{x}) >= {span} THEN sum({b}.{x} * pow({decay!r}, {a}.n - {b}.n)) / sum(pow({decay!r}, {a}.n - {b}.n)) FILTER ({b}.{x} IS NOT NULL) END"


@query(f"""WITH {TYPE_BARS}, r AS (SELECT *, row_number() OVER w AS n, coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr FROM bars WINDOW w AS (PARTITION BY key ORDER BY day)),
    m AS (SELECT a.key, a.day, a.n, {_ewm_of('close', 12)} - {_ewm_of('close', 26)} AS macd, {_ewm_of('tr', 14)} AS atr FROM r a JOIN r b ON a.key = b.key AND b.n <= a.n GROUP BY a.key, a.day, a.n)
    SELECT a.key, a.day, round(any_value(a.macd), 6) AS macd, round({_ewm_of('macd', 9)}, 6) AS macd_signal, round(any_value(a.atr), 6) AS atr FROM m a JOIN m b ON a.key = b.key AND b.n <= a.n GROUP BY a.key, a.day""")
def macd_atr(t: Tables) -> DataFrame:
    """MACD, its signal line and exponential ATR (held against pandas in the tests as well)."""
    out = W.indicators(_bars(t, "event_type"))
    return out.select("key", "day", *(r6(c).alias(c) for c in ("macd", "macd_signal", "atr")))


@query("""WITH d AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, last(value ORDER BY ts, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL), c AS (SELECT DISTINCT key, x.day FROM d, (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-01-25', INTERVAL 1 DAY)) AS DATE) AS day) x)
    SELECT c.key, c.day, (SELECT last(value ORDER BY d.day) FROM d WHERE d.key = c.key AND d.day <= c.day) AS value FROM c""")
def ffill_calendar(t: Tables) -> DataFrame:
    at = F.struct("ts", "event_id")
    daily = t.events.where("event_type = 'view'").groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("day")).agg(F.max_by("value", at).alias("value"))
    return W.fill_forward(daily, "key", "day", "value", "2024-01-05", "2024-01-25")


@query(f"""WITH {BARS} SELECT key, day, close, round(lead(close, 1) OVER w / close - 1, 6) AS t1, round(lead(close, 3) OVER w / close - 1, 6) AS t3, round(lead(close, 5) OVER w / close - 1, 6) AS t5,
    CASE WHEN lead(close, 3) OVER w IS NULL THEN NULL WHEN (lead(close, 3) OVER w / close - 1) * 10000 > 1e-9 THEN 'WIN' WHEN (lead(close, 3) OVER w / close - 1) * 10000 < -1e-9 THEN 'LOSS' ELSE 'FLAT' END AS label
    FROM bars WINDOW w AS (PARTITION BY key ORDER BY day)""")
def tplus_outcome(t: Tables) -> DataFrame:
    return K.outcomes_after(_bars(t), (1, 3, 5), 3).select("key", "day", "close", *(r6(c).alias(c) for c in ("t1", "t3", "t5")), "label")


@query(f"""WITH {BARS}, m AS (SELECT *, avg(close) OVER (PARTITION BY key ORDER BY day ROWS 19 PRECEDING) AS ma FROM bars) SELECT day, sum(CASE WHEN close > ma THEN 1 ELSE 0 END)::BIGINT AS above, count(*) AS n, round(2.0 * sum(CASE WHEN close > ma THEN 1 ELSE 0 END) / count(*) - 1, 6) AS breadth FROM m GROUP BY 1""")
def breadth_ma20(t: Tables) -> DataFrame:
    return W.breadth(_bars(t)).select("day", F.col("above").cast("long").alias("above"), "n", r6("breadth").alias("breadth"))


@query(f"WITH {TYPE_BARS} SELECT day, round(avg(open), 6) AS open, round(avg(close), 6) AS close, count(*) AS peers, string_agg(key, ',' ORDER BY key) AS members FROM bars GROUP BY 1")
def proxy_index(t: Tables) -> DataFrame:
    return W.peer_index(_bars(t, "event_type")).select("day", r6("open").alias("open"), r6("close").alias("close"), "peers", "members")


@query(f"""WITH {TYPE_BARS}, i AS (SELECT day, avg(close) AS c FROM bars GROUP BY 1), m AS (SELECT day, coalesce(c / lag(c) OVER (ORDER BY day) - 1, 0) AS mkt FROM i), r AS (SELECT key, day, coalesce(close / lag(close) OVER (PARTITION BY key ORDER BY day) - 1, 0) AS ret FROM bars),
    j AS (SELECT key, day, ret, mkt, sum(ret * mkt) OVER w AS ab, sum(mkt * mkt) OVER w AS bb FROM r JOIN m USING (day) WINDOW w AS (PARTITION BY key ORDER BY day ROWS 19 PRECEDING))
    SELECT key, day, round(CASE WHEN bb > 1e-12 THEN ab / bb ELSE 0 END, 6) AS beta, round(ret - CASE WHEN bb > 1e-12 THEN ab / bb ELSE 0 END * mkt, 6) AS residual FROM j""")
def beta_residual(t: Tables) -> DataFrame:
    bars = _bars(t, "event_type")
    return W.beta(bars, W.peer_index(bars)).select("key", "day", r6("beta").alias("beta"), r6("residual").alias("residual"))


@query(f"""WITH {TYPE_BARS}, w AS (SELECT key, day, close, list(close) OVER (PARTITION BY key ORDER BY day ROWS 19 PRECEDING) AS l FROM bars)
    SELECT key, day, round(CASE WHEN list_stddev_pop(l) > 1e-12 THEN (close - list_avg(l)) / list_stddev_pop(l) ELSE 0 END, 6) AS zscore, round(close - l[1], 6) AS change, round(len(list_filter(l, lambda v: v <= close)) / len(l), 6) AS percentile,
    round(CASE WHEN len(l) > 1 THEN (close - l[1]) / (len(l) - 1) ELSE 0 END, 6) AS slope FROM w""")
def macro_trailing(t: Tables) -> DataFrame:
    series = _bars(t, "event_type").select("key", "day", F.col("close").alias("value"))
    return W.macro_features(series).select("key", "day", *(r6(c).alias(c) for c in ("zscore", "change", "percentile", "slope")))


@query(f"""WITH {TYPE_BARS}, s AS (SELECT key, day, close - lag(close) OVER (PARTITION BY key ORDER BY day) AS d FROM bars), g AS (SELECT day, avg(CASE WHEN d > 1e-12 THEN 1 WHEN d < -1e-12 THEN -1 ELSE 0 END) AS score FROM s GROUP BY 1)
    SELECT day, round(score, 6) AS score, CASE WHEN score > 0.2 THEN 'RISK_ON' WHEN score < -0.2 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS regime FROM g""")
def regime_by_day(t: Tables) -> DataFrame:
    """Mean sign of the macro series' moves, in three states."""
    moves = _bars(t, "event_type").withColumn("d", F.col("close") - F.lag("close").over(W.by()))
    score = moves.groupBy("day").agg(F.avg(dead_zone_sign(F.col("d"))).alias("score"))
    state = F.when(F.col("score") > 0.2, "RISK_ON").when(F.col("score") < -0.2, "RISK_OFF").otherwise("NEUTRAL")
    return score.select("day", r6("score").alias("score"), state.alias("regime"))


@query(f"""WITH {BARS}, f AS (SELECT key, day, lead(open) OVER (PARTITION BY key ORDER BY day) AS entry, coalesce(list(high) OVER w, []) AS hi, coalesce(list(low) OVER w, []) AS lo, coalesce(list(close) OVER w, []) AS cl FROM bars WINDOW w AS (PARTITION BY key ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
    x AS (SELECT *, nullif(coalesce(list_position(list_transform(hi, lambda v: v >= entry * 1.05), TRUE), 0), 0) AS up, nullif(coalesce(list_position(list_transform(lo, lambda v: v <= entry * 0.95), TRUE), 0), 0) AS dn,
          len(list_filter(range(1, len(hi) + 1), lambda i: hi[i] >= entry * 1.05 AND lo[i] <= entry * 0.95 OR lo[i] <= entry * 0.95 AND hi[i] >= entry * 1.05)) > 0 AS two, cl[-1] / entry - 1 AS gross FROM f WHERE entry > 0)
    SELECT key, day, CASE WHEN two THEN 'AMBIGUOUS' WHEN up IS NOT NULL AND (dn IS NULL OR up < dn) THEN 'UP_FIRST' WHEN dn IS NOT NULL AND (up IS NULL OR dn < up) THEN 'DOWN_FIRST' WHEN abs(gross - 0.001) <= 0.002 THEN 'FLAT' WHEN gross - 0.001 > 0 THEN 'HORIZON_UP' ELSE 'HORIZON_DOWN' END AS path_label,
    CAST(up AS INT) AS target_day, CAST(dn AS INT) AS stop_day, round(greatest(-1, least(1, gross)), 6) AS gross FROM x""")
def first_touch_label(t: Tables) -> DataFrame:
    """Which of target and stop is touched first in the bars after each date, and the outcome at the horizon."""
    out = K.event_outcomes(_bars(t), horizon=5, target=0.05, stop=0.05, fee_bps=5.0, slippage_bps=5.0, flat_band=0.002)
    return out.select("key", "day", "path_label", F.col("buy.target_day").alias("target_day"), F.col("buy.stop_day").alias("stop_day"), r6("buy.horizon_return").alias("gross"))


OUTCOMES = f"""WITH {BARS}, f AS (SELECT key, day, lead(open) OVER (PARTITION BY key ORDER BY day) AS e, coalesce(list(high) OVER w, []) AS hi, coalesce(list(low) OVER w, []) AS lo, coalesce(list(close) OVER w, []) AS cl FROM bars WINDOW w AS (PARTITION BY key ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
    x AS (SELECT *, nullif(list_position(list_transform(hi, lambda v: v >= e * (1 + 0.04)), TRUE), 0) AS bt, nullif(list_position(list_transform(lo, lambda v: v <= e * (1 - 0.03)), TRUE), 0) AS bs, nullif(list_position(list_transform(lo, lambda v: v <= e * (1 - 0.04)), TRUE), 0) AS st, nullif(list_position(list_transform(hi, lambda v: v >= e * (1 + 0.03)), TRUE), 0) AS ss,
          len(list_filter(range(1, len(hi) + 1), lambda i: hi[i] >= e * (1 + 0.04) AND lo[i] <= e * (1 - 0.03) OR lo[i] <= e * (1 - 0.04) AND hi[i] >= e * (1 + 0.03))) > 0 AS two, cl[-1] / e - 1 AS g, greatest(0, list_max(hi) / e - 1) AS best, least(0, list_min(lo) / e - 1) AS worst, list_max(hi) / e - 1 AS top, list_min(lo) / e - 1 AS bottom FROM f WHERE e > 0),
    y AS (SELECT *, CASE WHEN two AND bt IS NOT NULL AND bt = bs THEN 'AMBIGUOUS' WHEN coalesce(bt, 99) < coalesce(bs, 99) THEN 'UP_FIRST' WHEN coalesce(bs, 99) < coalesce(bt, 99) THEN 'DOWN_FIRST' WHEN abs(g) <= 0.005 THEN 'FLAT' WHEN g > 0 THEN 'HORIZON_UP' ELSE 'HORIZON_DOWN' END AS bl,
          CASE WHEN two AND st IS NOT NULL AND st = ss THEN 'AMBIGUOUS' WHEN coalesce(st, 99) < coalesce(ss, 99) THEN 'UP_FIRST' WHEN coalesce(ss, 99) < coalesce(st, 99) THEN 'DOWN_FIRST' WHEN abs(g) <= 0.005 THEN 'FLAT' WHEN -g > 0 THEN 'HORIZON_UP' ELSE 'HORIZON_DOWN' END AS sl FROM x),
    z AS (SELECT *, CASE WHEN bl IN ('UP_FIRST', 'AMBIGUOUS') THEN bt WHEN bl = 'DOWN_FIRST' THEN bs END AS days FROM y)"""


@query(f"""{OUTCOMES} SELECT key, day, CASE WHEN two THEN 'AMBIGUOUS' ELSE bl END AS path_label, round(greatest(0, least(1, 0.35::DOUBLE / (1 + exp(-8 * g)) + 0.25::DOUBLE / (1 + exp(-6 * g)) + 0.2::DOUBLE * greatest(0, least(1, 0.6::DOUBLE * best + 0.4::DOUBLE * greatest(0, 1 + worst))) + 0.2::DOUBLE * CASE WHEN days IS NULL THEN 0 ELSE 1 - least(days - 1, 4) / 4.0::DOUBLE END)), 6) AS quality,
    bl AS buy_label, round(greatest(-1, least(1, g)), 6) AS buy_after_cost, round(greatest(-1, least(1, worst)), 6) AS buy_mae, round(greatest(-1, least(1, best)), 6) AS buy_mfe, sl AS sell_label, round(greatest(-1, least(1, -g)), 6) AS sell_after_cost, round(greatest(-1, least(1, least(0, -top))), 6) AS sell_mae, round(greatest(-1, least(1, greatest(0, -bottom))), 6) AS sell_mfe FROM z""")
def event_outcomes_both_sides(t: Tables) -> DataFrame:
    """Outcomes of buying and selling, with excursions, costs and quality (held against plain Python in the tests)."""
    out = K.event_outcomes(_bars(t))
    return out.select("key", "day", "path_label", r6("quality").alias("quality"), *((F.col(f"{s}.{c}") if c == "label" else r6(F.col(f"{s}.{c}"))).alias(f"{s}_{c}") for s in ("buy", "sell") for c in ("label", "after_cost", "mae", "mfe")))


@query(f"""WITH {BARS}, a AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY key) AS c, abs(close - lag(close) OVER w) AS d FROM bars WINDOW w AS (PARTITION BY key ORDER BY day)),
    s AS (SELECT *, CASE WHEN count(d) OVER (PARTITION BY key ORDER BY day ROWS 6 PRECEDING) = 7 THEN avg(d) OVER (PARTITION BY key ORDER BY day ROWS 6 PRECEDING) END AS atr, lag(close, 1) OVER w AS p1, lag(close, 3) OVER w AS p3,
          stddev_samp(close) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS sd, min(close) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lo,
          max(close) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS hi FROM a WINDOW w AS (PARTITION BY key ORDER BY day))
    SELECT key, day, close, round((hi - close) / (close + 1e-9), 6) AS change FROM s WHERE n > 3 AND n <= c - 5 AND close > 1e-9 AND (p1 - p3) / 3 <= 0 AND sd < atr * 2 AND (hi - close) / (close + 1e-9) >= 0.05 AND (close - lo) / (close + 1e-9) <= 0.9""")
def trend_v1(t: Tables) -> DataFrame:
    return K.trend_v1(_bars(t), "UP", 3, 5, 0.05, 0.9, 2.0).select("key", "day", "close", r6("change").alias("change"))


@query(f"""WITH {BARS}, f AS (SELECT key, day, close, list(close) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS fut FROM bars), g AS (SELECT *, list_position(list_transform(fut, lambda v: v >= close * 1.05), TRUE) AS i FROM f WHERE len(fut) = 5 AND close > 0)
    SELECT key, day, close, round((fut[i] - close) / (close + 1e-9), 6) AS change FROM g WHERE i > 0 AND list_min(fut[i:]) >= fut[i] * 0.5""")
def trend_v4(t: Tables) -> DataFrame:
    return K.trend_v4(_bars(t), "UP", 5, 0.05, 0.5).select("key", "day", "close", r6("change").alias("change"))


#: Both detectors; the second by recursion over each key's rows, carrying its recent changes, the change before and the last signal.
TRENDS = f"""WITH RECURSIVE {BARS}, a AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY key) AS c, abs(close - lag(close) OVER w) AS d FROM bars WINDOW w AS (PARTITION BY key ORDER BY day)),
    s AS (SELECT *, CASE WHEN count(d) OVER (PARTITION BY key ORDER BY day ROWS 6 PRECEDING) = 7 THEN avg(d) OVER (PARTITION BY key ORDER BY day ROWS 6 PRECEDING) END AS atr, (lag(close, 1) OVER w - lag(close, 3) OVER w) / 3 AS slope,
          stddev_samp(close) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS sd, min(close) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS past,
          max(close) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS hi, min(close) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS lo FROM a WINDOW w AS (PARTITION BY key ORDER BY day)),
    one AS (SELECT key, day, close, (hi - close) / (close + 1e-9) AS change FROM s WHERE n > 3 AND n <= c - 5 AND close > 1e-9 AND slope <= 0 AND sd < atr AND (hi - close) / (close + 1e-9) >= 0.05 AND (close - past) / (close + 1e-9) <= 5.0),
    x AS (SELECT key, day, close, n, (hi - close) / (close + 1e-12) AS ch, abs((lo - close) / (close + 1e-12)) AS ag, row_number() OVER (PARTITION BY key ORDER BY n) AS i FROM s WHERE n > 3 AND n <= c - 5 AND close > 1e-12 AND NOT coalesce(slope <= 0 AND sd < atr + 1e-12, FALSE)),
    f AS (SELECT key, 0::BIGINT AS i, []::DOUBLE[] AS recent, NULL::DOUBLE AS before, NULL::BIGINT AS last, NULL::DOUBLE AS momentum, NULL::DATE AS day, NULL::DOUBLE AS close, NULL::DOUBLE AS ch FROM (SELECT DISTINCT key FROM x)
          UNION ALL SELECT f.key, x.i, list_append(f.recent, x.ch)[-3:], CASE WHEN x.ch >= 0.05 AND x.ag <= 5.0 OR f.before IS NULL THEN x.ch ELSE f.before END,
          CASE WHEN {{take}} THEN x.n ELSE f.last END, CASE WHEN {{take}} THEN {{gain}} END, x.day, x.close, x.ch FROM f JOIN x ON f.key = x.key AND x.i = f.i + 1),
    two AS (SELECT key, day, close, ch AS change, momentum FROM f WHERE momentum IS NOT NULL)"""
_GAIN = "CASE WHEN f.before IS NULL THEN 0.0 ELSE x.ch - f.before END"
TRENDS = TRENDS.format(gain=_GAIN, take=f"x.ch >= 0.05 AND x.ag <= 5.0 AND {_GAIN} > 0.05 * 0.35 AND (len(f.recent) = 0 OR x.ch > list_max(f.recent)) AND (f.last IS NULL OR x.n - f.last >= 2)")


@query(f"{TRENDS} SELECT key, day, close, round(change, 6) AS change, round(momentum, 6) AS momentum FROM two")
def trend_v2(t: Tables) -> DataFrame:
    """Stateful continuation signals, one fold a key (held against plain Python in the tests as well)."""
    return K.trend_v2(_bars(t), "UP", 3, 5, 0.05, 5.0, 1.0).select("key", "day", "close", r6("change").alias("change"), r6("momentum").alias("momentum"))


@query(f"""{TRENDS} SELECT key, day, close, round(change, 6) AS change, 1 AS detector FROM one UNION ALL SELECT key, day, close, round(change, 6), 2 FROM two WHERE (key, day) NOT IN (SELECT (key, day) FROM one)""")
def trend_v3(t: Tables) -> DataFrame:
    """Signals of the first and second detector, the first winning a shared date."""
    return K.trend_v3(_bars(t), "UP", 3, 5, 0.05, 5.0, 1.0).select("key", "day", "close", r6("change").alias("change"), "detector")


@query(f"""WITH {TYPE_BARS}, r AS (SELECT key, day, coalesce(close / lag(close) OVER (PARTITION BY key ORDER BY day) - 1, 0) AS ret FROM bars), e AS (SELECT *, sum(ret) OVER (PARTITION BY key ORDER BY day) AS eq FROM r), p AS (SELECT key, eq, greatest(0, max(eq) OVER (PARTITION BY key ORDER BY day)) AS peak FROM e)
    SELECT key, round(max(peak - eq), 6) AS max_drawdown FROM p GROUP BY 1""")
def max_drawdown_additive(t: Tables) -> DataFrame:
    return K.additive_drawdown(_bars(t, "event_type").withColumn("ret", F.coalesce(W.change(1), F.lit(0.0)))).select("key", r6("max_drawdown").alias("max_drawdown"))


@query(f"""WITH {BARS}, r AS (SELECT key, close, high, low, row_number() OVER (PARTITION BY key ORDER BY day DESC) AS n FROM bars)
    SELECT key, max(close) FILTER (n = 1) AS price, round(CASE WHEN count(*) FILTER (n <= 14) < 5 THEN 0.05 ELSE greatest(0.01, least(0.2, avg((high - low) / close) FILTER (n <= 14 AND close > 0))) END, 6) AS atr_pct FROM r GROUP BY 1""")
def latest_price_atr(t: Tables) -> DataFrame:
    return K.latest_price_and_range(_bars(t)).select("key", "price", r6("atr_pct").alias("atr_pct"))


@query(f"""WITH {BARS}, n AS (SELECT key, first(open ORDER BY day) AS o, last(close ORDER BY day) AS c, max(high) AS h, min(low) AS l, avg(volume) AS v FROM bars GROUP BY 1)
    SELECT key, round(CASE WHEN abs(o) > 1e-12 THEN (c - o) / o ELSE 0 END, 6) AS ret, round(CASE WHEN abs(c) > 1e-12 THEN (h - l) / c ELSE 0 END, 6) AS range_pct, round(v, 6) AS mean_volume FROM n""")
def whole_slice_features(t: Tables) -> DataFrame:
    a = _bars(t).groupBy("key").agg(F.min_by("open", "day").alias("o"), F.max_by("close", "day").alias("c"), F.max("high").alias("h"), F.min("low").alias("l"), F.avg("volume").alias("v"))
    return a.select("key", r6(guarded_div(F.col("c") - F.col("o"), F.col("o"))).alias("ret"), r6(guarded_div(F.col("h") - F.col("l"), F.col("c"))).alias("range_pct"), r6("v").alias("mean_volume"))


@query(f"""WITH {BARS} SELECT key, count(*) AS held, count(*) FILTER (day > DATE '2024-01-15') AS after FROM bars GROUP BY 1""")
def business_days_held(t: Tables) -> DataFrame:
    return _bars(t).groupBy("key").agg(F.count("*").alias("held"), F.count_if(F.col("day") > "2024-01-15").alias("after"))


@query(f"""WITH {TYPE_BARS}, s AS (SELECT key, day, CASE WHEN close > lag(close) OVER (PARTITION BY key ORDER BY day) THEN 1 ELSE 0 END AS up FROM bars), g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) - row_number() OVER (PARTITION BY key, up ORDER BY day) AS island FROM s)
    SELECT key, max(n) AS longest FROM (SELECT key, island, count(*) FILTER (up = 1) AS n FROM g GROUP BY key, island, up) GROUP BY 1""")
def longest_rise(t: Tables) -> DataFrame:
    """Longest run of rising days, by gaps and islands."""
    up = _bars(t, "event_type").withColumn("up", F.when(F.col("close") > F.lag("close").over(W.by()), 1).otherwise(0))
    island = F.row_number().over(W.by()) - F.row_number().over(Window.partitionBy("key", "up").orderBy("day"))
    runs = up.withColumn("island", island).groupBy("key", "up", "island").agg(F.count_if(F.col("up") == 1).alias("n"))
    return runs.groupBy("key").agg(F.max("n").alias("longest"))


@query("""
    WITH x AS (SELECT event_id, user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM x)
    SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s.n""")
def sessions(t: Tables) -> DataFrame:
    """Sessions of a two-hour gap (beyond the reference's own operators)."""
    out = t.events.withColumn("at", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("at", "2 hours")).agg(F.min("ts").alias("start"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("user_id", "start", "n", "total")


@query("""SELECT event_id, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE 1 - 1 / (1 + exp(x)) END, 6) AS p, round(tanh(x), 6) AS t, round(greatest(0.01, least(0.2, x)), 6) AS c FROM (SELECT event_id, value / 100 - 2.5 AS x FROM events)""")
def squashing(t: Tables) -> DataFrame:
    x = F.col("value") / 100 - 2.5
    return t.events.select("event_id", r6(logistic(x)).alias("p"), r6(F.tanh(x)).alias("t"), r6(clip(x, 0.01, 0.2)).alias("c"))


@query()
def leader_clusters(t: Tables) -> DataFrame:
    """Greedy leader clustering of each label's vectors in id order (held against plain Python in the tests)."""
    return K.leader_clusters(t.embeddings.select(F.col("label").alias("as_of"), F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector")), 0.5)


@query()
def ladders(t: Tables) -> DataFrame:
    """Order ladders of parts as candidates, one row a leg."""
    c = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10).alias("price"), (F.pmod(F.col("p_partkey"), F.lit(21)) / 10.0 - 1).alias("strength"), F.pmod(F.col("p_partkey") * 7, F.lit(60)).cast("long").alias("quantity"))
    c = c.repartition("id")  # a small file is one split, but much work
    return K.ladder(c, "US").unionByName(K.ladder(c, "US", side="SELL"))


@query("""WITH RECURSIVE c AS (SELECT c_mktsegment AS batch, c_custkey AS id, abs(c_acctbal) / 40 + 1 AS price, (c_custkey % 10) / 10.0::DOUBLE AS signal, count(*) OVER (PARTITION BY c_mktsegment) AS size FROM customer),
    l AS (SELECT *, least(40000.0::DOUBLE / size, 5000.0::DOUBLE) AS cap, 2 * (floor(CAST(price * (1 - greatest(0.012::DOUBLE, 0.4::DOUBLE * 0.03::DOUBLE)) AS DECIMAL(28,14)) / 0.01 + 0.5) * 0.01)::DOUBLE AS required FROM c WHERE price > 0 AND signal > 0),
    p AS (SELECT *, signal / greatest(price * 0.03::DOUBLE, 1e-9) * sqrt(least(1, cap / greatest(required, 1e-9))) AS priority, least(required, cap) AS need FROM l),
    k AS (SELECT * FROM (SELECT *, sum(need) OVER (PARTITION BY batch ORDER BY price, id ROWS UNBOUNDED PRECEDING) AS running FROM p) WHERE running <= 20000 AND need > 0),
    o AS (SELECT *, sum(priority) OVER (PARTITION BY batch) AS total, 20000 - sum(need) OVER (PARTITION BY batch) AS rest0, row_number() OVER (PARTITION BY batch ORDER BY priority DESC, price, id) AS i FROM k),
    f AS (SELECT batch, 0::BIGINT AS i, max(rest0) AS rest, NULL::BIGINT AS id, 0.0::DOUBLE AS budget FROM o GROUP BY batch
          UNION ALL SELECT f.batch, o.i, f.rest - greatest(0, least(o.cap - o.need, f.rest * o.priority / o.total)), o.id, o.need + greatest(0, least(o.cap - o.need, f.rest * o.priority / o.total)) FROM f JOIN o ON f.batch = o.batch AND o.i = f.i + 1)
    SELECT batch, id, round(budget, 4) AS budget FROM f WHERE id IS NOT NULL""")
def budget_allocation(t: Tables) -> DataFrame:
    """Two-pass budgets of each segment's candidates."""
    c = t.customer.select(F.col("c_mktsegment").alias("batch"), F.col("c_custkey").alias("id"), (F.abs("c_acctbal") / 40 + 1).alias("price"), F.lit(0.03).alias("atr_pct"), (F.pmod(F.col("c_custkey"), F.lit(10)) / 10.0).alias("signal"))
    return K.allocate(c, 20_000.0).select("batch", "id", r6("budget", 4).alias("budget"))


@query("""WITH RECURSIVE c AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS id, 'S' || (o_custkey % 7) AS sector, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, o_totalprice / 1e6 - 0.05::DOUBLE AS ev, (o_orderkey % 10) / 10.0::DOUBLE AS conf, (o_orderkey % 4) / 10.0::DOUBLE AS overlap, o_orderkey % 13 = 0 AS held FROM orders),
    u AS (SELECT *, 0.5::DOUBLE + 0.35::DOUBLE * ev + 0.1::DOUBLE * conf - 0.5::DOUBLE * 0.1::DOUBLE - 0.25::DOUBLE * overlap AS utility FROM c), o AS (SELECT *, 90000.0::DOUBLE * 0.95 / 5 * greatest(0.25, least(1.5, 1 + utility)) AS wish, row_number() OVER (PARTITION BY day ORDER BY utility DESC, ev DESC, conf DESC, id) AS i FROM u),
    f AS (SELECT day, 0::BIGINT AS i, []::VARCHAR[] AS secs, []::VARCHAR[] AS grps, 0.0::DOUBLE AS spent, NULL::BIGINT AS id, NULL::VARCHAR AS reason, 0.0::DOUBLE AS budget FROM o GROUP BY day
          UNION ALL SELECT day, i, CASE WHEN reason IS NULL THEN list_append(secs, sector) ELSE secs END, CASE WHEN reason IS NULL THEN list_append(grps, side || sector) ELSE grps END, CASE WHEN reason IS NULL THEN spent + b ELSE spent END, id, reason, CASE WHEN reason IS NULL THEN b ELSE 0 END
          FROM (SELECT f.day, o.i, f.secs, f.grps, f.spent, o.id, o.sector, o.side, least(o.wish, greatest(0, 90000 - f.spent)) AS b, CASE WHEN o.held THEN 'already_open' WHEN o.ev < 0 THEN 'below_ev_threshold' WHEN len(list_filter(f.secs, lambda x: x = o.sector)) >= 2 THEN 'sector_cap'
                WHEN list_contains(f.grps, o.side || o.sector) THEN 'correlated_cap' WHEN len(f.secs) >= 5 THEN 'turnover_budget' WHEN least(o.wish, greatest(0, 90000 - f.spent)) <= 0 THEN 'capital_reserved' END AS reason FROM f JOIN o ON f.day = o.day AND o.i = f.i + 1))
    SELECT day, id, reason IS NULL AS selected, reason, round(budget, 4) AS budget FROM f WHERE id IS NOT NULL""")
def portfolio_greedy(t: Tables) -> DataFrame:
    """Greedy selection under sector, correlation and capital limits on each decision date."""
    k = F.col("o_orderkey")
    c = t.orders.select(
        F.to_date("o_orderdate").alias("day"), k.alias("id"), F.concat(F.lit("S"), F.pmod("o_custkey", F.lit(7)).cast("string")).alias("sector"), F.when(k % 3 == 0, "SELL").otherwise("BUY").alias("side"),
        (F.col("o_totalprice") / 1e6 - 0.05).alias("ev"), F.lit(0.1).alias("uncertainty"), (F.pmod("o_orderkey", F.lit(10)) / 10.0).alias("confidence"), F.lit(0.5).alias("policy_utility"), F.lit(1.0).alias("size"),
        F.lit(False).alias("no_trade"), (k % 13 == 0).alias("held"), (k % 4 / 10.0).alias("overlap"),
    )
    return K.select_portfolio(c, 100_000.0, cash=95_000.0, reserved=5_000.0).select("day", "id", "selected", "reason", r6("budget", 4).alias("budget"))


@query()
def broker_fills(t: Tables) -> DataFrame:
    """Simulated fills of limit orders against the bars after them."""
    bars = _bars(t, "event_type")
    legs = bars.where("day < '2024-01-20'").select("key", "day", F.xxhash64("key", "day").alias("leg_id"), (F.col("close") * 0.9).alias("limit_price"), F.lit(10).cast("long").alias("quantity"), F.lit("BUY").alias("side"))
    return K.simulate_fills(legs, bars, slippage_bps=5.0).drop("leg_id")


OPEN_CASH = 12_000.0


def _opening(t: Tables) -> DataFrame:
    """Parts as candidates, a batch for each brand; some without a price or a signal."""
    k = F.col("p_partkey")
    return t.part.select(
        F.col("p_brand").alias("batch"), k.alias("id"), F.when(k % 37 != 0, F.col("p_retailprice") / 10).alias("price"), F.when(k % 11 != 0, (F.col("p_size") % 10 + 1) / 100.0).alias("atr_pct"), ((k % 21) / 20.0).alias("signal"),
        (1 + (F.col("p_size") % 4) / 4.0).alias("multiplier"), (k % 13 == 0).alias("earnings"),
    )


def _opening_sql() -> str:
    return f"""WITH RECURSIVE c AS (SELECT p_brand AS batch, p_partkey AS id, CASE WHEN p_partkey % 37 <> 0 THEN p_retailprice / 10 END AS price, coalesce(CASE WHEN p_partkey % 11 <> 0 THEN (p_size % 10 + 1) / 100.0::DOUBLE END, 0.05) AS atr, (p_partkey % 21) / 20.0::DOUBLE AS signal, count(*) OVER (PARTITION BY p_brand) AS size FROM part),
    l AS (SELECT *, least(2 * {OPEN_CASH}::DOUBLE / size, 0.3 * {OPEN_CASH}::DOUBLE) AS cap, (floor(CAST(price * (1 - greatest(0.012::DOUBLE, 0.4::DOUBLE * atr)) AS DECIMAL(28,14)) / 0.01 + 0.5) * 0.01)::DOUBLE AS first FROM c WHERE price > 0 AND signal > 0),
    p AS (SELECT *, signal / greatest(price * atr, 1e-9) * pow(least(1, cap / greatest(3 * first, 1e-9)), 2) AS priority, least(3 * first, cap) AS need FROM l),
    k AS (SELECT * FROM (SELECT *, sum(need) OVER (PARTITION BY batch ORDER BY price, id ROWS UNBOUNDED PRECEDING) AS running FROM p) WHERE running <= {OPEN_CASH} AND need > 0),
    o AS (SELECT *, sum(priority) OVER (PARTITION BY batch) AS total, {OPEN_CASH} - sum(need) OVER (PARTITION BY batch) AS rest0, row_number() OVER (PARTITION BY batch ORDER BY priority DESC, price, id) AS i FROM k),
    f AS (SELECT batch, 0::BIGINT AS i, max(rest0) AS rest, NULL::BIGINT AS id, 0.0::DOUBLE AS budget FROM o GROUP BY batch
          UNION ALL SELECT f.batch, o.i, f.rest - greatest(0, least(o.cap - o.need, f.rest * o.priority / o.total)), o.id, o.need + greatest(0, least(o.cap - o.need, f.rest * o.priority / o.total)) FROM f JOIN o ON f.batch = o.batch AND o.i = f.i + 1),
    u AS (SELECT c.batch, c.id, c.price, c.signal, f.budget, coalesce(floor(f.budget / greatest(first, 1e-6)), 0)::BIGINT AS units FROM c LEFT JOIN l USING (batch, id) LEFT JOIN f ON f.batch = c.batch AND f.id = c.id)
    SELECT batch, id, CASE WHEN price IS NULL OR price <= 0 OR signal <= 0 THEN 'INVALID' WHEN budget IS NULL THEN 'BUDGET_ALLOCATION' WHEN units <= 0 THEN 'BUDGET' WHEN units < 3 THEN 'GRANULARITY' ELSE 'OK' END AS code, round(budget, 4) AS budget, units FROM u"""


@query(_opening_sql())
def open_plan_codes(t: Tables) -> DataFrame:
    """What each candidate of an opening session is bought with, or the reason that it is not."""
    out = O.candidate_codes(_opening(t), OPEN_CASH, weight=0.3, penalty=2.0, micro=False)
    return out.select("batch", "id", "code", r6("budget", 4).alias("budget"), "units")


@query()
def open_plans(t: Tables) -> DataFrame:
    """The whole plan: legs after news and earnings, or one reason a candidate."""
    return O.buy_plans(_opening(t), OPEN_CASH, weight=0.3, penalty=2.0, micro=False)


VERSIONS = (0, 1, 2)


def _standing(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Lines as standing legs of their part, and three predictions of each part."""
    k, v = F.col("p_partkey"), F.col("version")
    price = lambda n: F.col("p_retailprice") / 10 * (1 + ((k + n) % 7 - 3) / 200.0)
    parts = t.part.select("p_partkey", "p_retailprice", F.explode(F.array(*map(F.lit, VERSIONS))).alias("version"))
    predictions = parts.select("version", k.alias("symbol"), price(v).alias("price"), ((k * 3 + v * 5) % 21 / 10.0 - 1).alias("strength"), ((k + v) % 5 / 100.0).alias("expected_up"), ((k + 2 * v) % 4 / 100.0).alias("expected_down"))
    lines = R.top_per(t.lineitem, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")])
    off = F.col("l_discount") * 0.5 + 0.002
    sells = F.col("l_returnflag") == "R"
    legs = lines.join(t.part.select("p_partkey", (F.col("p_retailprice") / 10).alias("base")), F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("leg_id"), F.col("p_partkey").alias("symbol"), F.when(sells, "SELL").otherwise("BUY").alias("side"), r6(F.col("base") * F.when(sells, 1 + off).otherwise(1 - off), 2).alias("limit_price"),
    )
    return legs, predictions


def _rebalance_sql() -> str:
    t = Z.RatchetTuning()
    tick = lambda x: f"(floor(CAST({x} AS DECIMAL(28,14)) / 0.01 + 0.5) * 0.01)::DOUBLE"
    at = lambda share: tick(f"(old + (price - old) * ({share}) * exp(-abs(price - old) / greatest(price, 1e-6) / {t.fade}::DOUBLE))")
    up, down = f"{t.per_expected}::DOUBLE * greatest(0, eu)", f"{t.per_expected}::DOUBLE * greatest(0, ed)"
    steps, last = [], "legs"
    for v in VERSIONS:
        steps.append(f"""
    q{v} AS (SELECT l.*, l.limit_price AS old, p.price, p.s, p.eu, p.ed FROM {last} l LEFT JOIN pred p ON p.symbol = l.symbol AND p.version = {v} AND abs(p.s) >= {t.least_strength}),
    n{v} AS (SELECT symbol, arg_min(old, [abs(price - old), leg_id]) FILTER (side = 'BUY') AS nb, arg_min(old, [abs(price - old), leg_id]) FILTER (side = 'SELL') AS ns, arg_min(old, [abs(price - old), leg_id]) FILTER (side = 'SELL' AND old > price) AS na FROM q{v} WHERE price IS NOT NULL GROUP BY 1),
    c{v} AS (SELECT q.*, nb, ns, na, {at(f"least(least({t.up_step_most}::DOUBLE, {t.up_step}::DOUBLE + {up}) / {t.unit}::DOUBLE, {t.up_most}::DOUBLE)")} AS bu, {at(f"least(({t.sell_up_step}::DOUBLE + {up}) / {t.unit}::DOUBLE, {t.up_most}::DOUBLE)")} AS su,
        {at(f"-least(least({t.up_step_most}::DOUBLE, {t.up_step}::DOUBLE + {down}) / {t.unit}::DOUBLE, {t.down_most}::DOUBLE)")} AS bd, greatest({at(f"-least(least({t.sell_down_step_most}::DOUBLE, {t.sell_down_step}::DOUBLE + {down}) / {t.unit}::DOUBLE, {t.down_most}::DOUBLE)")}, {tick("price * 1.0001::DOUBLE")}) AS sd FROM q{v} q LEFT JOIN n{v} USING (symbol)),
    m{v} AS (SELECT leg_id, symbol, side, first_price, old, CASE WHEN s >= {t.least_strength} AND side = 'BUY' AND (price - nb) / price >= {t.trigger_discount}::DOUBLE AND bu > old AND bu < price THEN bu WHEN s >= {t.least_strength} AND side = 'SELL' AND (ns - price) / price <= {t.trigger_premium}::DOUBLE AND su > old AND su > price THEN su
        WHEN s <= -{t.least_strength} AND side = 'BUY' AND old < price AND bd < old AND bd < price THEN bd WHEN s <= -{t.least_strength} AND side = 'SELL' AND old > price AND (na - price) / price >= {t.least_premium}::DOUBLE AND sd < old AND sd > price THEN sd END AS new, moves FROM c{v}),
    l{v} AS (SELECT leg_id, symbol, side, first_price, coalesce(new, old) AS limit_price, moves + CASE WHEN new IS NULL THEN 0 ELSE 1 END AS moves FROM m{v})""")
        last = f"l{v}"
    return f"""WITH x AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
    pred AS (SELECT version, p_partkey AS symbol, p_retailprice / 10 * (1 + ((p_partkey + version) % 7 - 3) / 200.0::DOUBLE) AS price, (p_partkey * 3 + version * 5) % 21 / 10.0::DOUBLE - 1 AS s, (p_partkey + version) % 5 / 100.0::DOUBLE AS eu, (p_partkey + 2 * version) % 4 / 100.0::DOUBLE AS ed FROM part, (SELECT unnest([0, 1, 2]) AS version)),
    legs AS (SELECT l_orderkey * 10 + l_linenumber AS leg_id, p_partkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, round(p_retailprice / 10 * CASE WHEN l_returnflag = 'R' THEN 1 + (l_discount * 0.5::DOUBLE + 0.002::DOUBLE) ELSE 1 - (l_discount * 0.5::DOUBLE + 0.002::DOUBLE) END, 2) AS limit_price FROM x JOIN part ON p_partkey = l_partkey),
    legs0 AS (SELECT leg_id, symbol, side, limit_price AS first_price, limit_price, 0 AS moves FROM legs), {','.join(steps).replace("FROM legs l", "FROM legs0 l")}
    SELECT leg_id, symbol, side, first_price, round(limit_price, 2) AS limit_price, moves::BIGINT AS moves FROM {last}"""


@query(_rebalance_sql())
def rebalanced_legs(t: Tables) -> DataFrame:
    """Every line's limit after three predictions of its part, and how often it was moved."""
    legs, predictions = _standing(t)
    out = Z.carried(legs, predictions, VERSIONS)
    first = F.coalesce(F.get("moves", F.lit(0))["old_price"], F.col("limit_price"))
    return out.select("leg_id", "symbol", "side", first.alias("first_price"), r6("limit_price", 2).alias("limit_price"), F.size("moves").cast("long").alias("moves"))
