"""Walk-forward evaluation over bars from ``events``."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import artifacts as A
from ..operators import backtest as B
from ..operators import batch as J
from ..operators import folds as D
from ..operators import search as P
from ..session import held, shared_folder
from .aggregates import PHI
from .registry import Tables, query, r6
from .research import shape_steps
from .series import BARS, _bars

LOOKBACK, NEAREST, EXIT, LEAST = 8, 3, 3, 0.7


def _neighbours_sql() -> str:
    lists = ", ".join(f"list({c}) OVER past AS {c[0]}" for c in ("open", "high", "low", "close")) + ", list(volume::DOUBLE) OVER past AS v"
    return f"""WITH {BARS}, n AS (SELECT key, day, {lists}, lead(open) OVER w AS entry, lead(close, {EXIT}) OVER w AS exit, lead(day, {EXIT}) OVER w AS exit_day,
        max(high) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND {EXIT} FOLLOWING) AS peak FROM bars
        WINDOW w AS (PARTITION BY key ORDER BY day), past AS (PARTITION BY key ORDER BY day ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)),
    p AS (SELECT * FROM n WHERE len(o) = {LOOKBACK} AND exit_day IS NOT NULL), {shape_steps("key, day, entry, exit, exit_day, peak")},
    x AS (SELECT q.key, q.day, list_cosine_similarity(q.v2, e.v2) AS sim, e.exit > e.entry AS up, row_number() OVER (PARTITION BY q.key, q.day ORDER BY list_cosine_similarity(q.v2, e.v2) DESC, e.key, e.day) AS place
        FROM k q JOIN k e ON q.key % 50 = 0 AND e.exit_day < q.day),
    hits AS (SELECT key, day FROM x WHERE place <= {NEAREST} GROUP BY ALL HAVING count(*) FILTER (up) = {NEAREST} AND max(sim) >= {LEAST}),
    g AS (SELECT key, count(*) AS signals, count(*) FILTER (exit > entry) AS correct, count(*) FILTER (entry > 0 AND (peak - entry) / entry >= 0.05) AS peaks, sum(entry) AS invested, sum(exit - entry) AS profit FROM k SEMI JOIN hits USING (key, day) GROUP BY 1)
    SELECT key, min(day) AS from_day, max(day) AS to_day, coalesce(any_value(signals), 0) AS signals, coalesce(any_value(correct), 0) AS correct, coalesce(any_value(peaks), 0) AS peaks, round(coalesce(any_value(profit), 0), 6) AS profit,
    round(coalesce(any_value(correct / signals), 0), 6) AS win_rate, round(coalesce(any_value(peaks / signals), 0), 6) AS peak_rate, round(coalesce(any_value(CASE WHEN invested > 0 THEN profit / invested END), 0), 6) AS return_rate
    FROM bars LEFT JOIN g USING (key) WHERE key % 50 = 0 GROUP BY 1"""


@query(_neighbours_sql())
def neighbour_backtest(t: Tables) -> DataFrame:
    """Keys that 50 divides ask with every bar, against the earlier bars of all keys."""
    out = B.neighbour_backtest(_bars(t), F.col("key") % 50 == 0, LOOKBACK, NEAREST, EXIT, LEAST)
    return out.select("key", "from_day", "to_day", "signals", "correct", "peaks", *(r6(c).alias(c) for c in ("profit", "win_rate", "peak_rate", "return_rate")))


HORIZON, FEE = 3, 0.001
PLANS = f"""{BARS}, m AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS move, lead(day) OVER w AS entry_day, lead(open) OVER w AS entry,
    last_value(close) OVER p AS exit, last_value(day) OVER p AS exit_day FROM bars WINDOW w AS (PARTITION BY key ORDER BY day), p AS (PARTITION BY key ORDER BY day ROWS BETWEEN 2 FOLLOWING AND {HORIZON + 1} FOLLOWING)),
    o AS (SELECT key, day, CASE WHEN move < 0 THEN 'BUY' ELSE 'SELL' END AS side, floor(least(abs(move), 1) * 1000) / 1000 AS score, coalesce(volume >= 2 AND entry > 0, false) AS filled,
          CASE WHEN exit IS NULL THEN 0 WHEN move < 0 THEN (exit - entry) / entry - {FEE} ELSE (entry - exit) / entry - {FEE} END AS ret, entry_day, exit_day, entry * 10 AS notional FROM m WHERE move IS NOT NULL),
    days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS ord FROM (SELECT DISTINCT day FROM o)), nd AS (SELECT count(*) AS n FROM days),
    r AS (SELECT o.*, ord, CASE WHEN filled THEN ret ELSE 0 END AS got, round(score * 1000) AS step FROM o JOIN days USING (day))"""


def _plans(t: Tables) -> DataFrame:
    """A plan for each bar with one before it: buy what fell, sell what rose; filled at the next open on days with two ticks or more."""
    w = Window.partitionBy("key").orderBy("day")
    path = w.rowsBetween(2, HORIZON + 1)
    m = _bars(t).withColumns({
        "move": F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1, "entry_day": F.lead("day").over(w), "entry": F.lead("open").over(w), "exit": F.last("close").over(path), "exit_day": F.last("day").over(path),
    }).where("move IS NOT NULL")
    falls, change = F.col("move") < 0, (F.col("exit") - F.col("entry")) / F.nullif(F.col("entry"), F.lit(0.0))
    return m.select(
        "key", "day", F.when(falls, "BUY").otherwise("SELL").alias("side"), (F.floor(F.least(F.abs("move"), F.lit(1.0)) * 1000) / 1000).alias("score"), F.coalesce((F.col("volume") >= 2) & (F.col("entry") > 0), F.lit(False)).alias("filled"),
        F.when(F.col("exit").isNull(), 0.0).when(falls, change - FEE).otherwise(-change - FEE).alias("ret"), "entry_day", "exit_day", (F.col("entry") * 10).alias("notional"),
    )


def _fold_sql(ranges: str) -> str:
    """Metrics of folds ``ranges(fold, part, lo, hi)`` by joining every plan with the folds that hold its day."""
    z = lambda share: f"(total / filled * {share}) / (sqrt(greatest((squares - 2 * (total / filled * {share}) * total + filled * (total / filled * {share}) * (total / filled * {share})) / (filled - 1), 1e-12)) / sqrt(filled))"
    return f"""WITH {PLANS}, {ranges}, f AS (SELECT DISTINCT fold, part, r.* FROM ranges JOIN r ON ord >= lo AND ord < hi), tt AS (SELECT * FROM f WHERE part = 'test'),
    g AS (SELECT fold, count(*) FILTER (part = 'train') AS train_plans, coalesce(sum(got) FILTER (part = 'train') / nullif(count(*) FILTER (part = 'train' AND filled), 0), 0) AS train_expectancy, count(*) FILTER (part = 'test') AS plans,
        count(*) FILTER (part = 'test' AND filled) AS filled, coalesce(sum(got) FILTER (part = 'test'), 0) AS total, coalesce(sum(got * got) FILTER (part = 'test'), 0) AS squares, coalesce(sum(notional) FILTER (part = 'test' AND filled), 0) AS turnover,
        count(*) FILTER (part = 'test' AND filled AND got > 0) AS wins, count(*) FILTER (part = 'test' AND filled AND side = 'BUY') AS longs, coalesce(sum(got) FILTER (part = 'test' AND side = 'BUY'), 0) AS lt, count(*) FILTER (part = 'test' AND filled AND side = 'SELL') AS shorts,
        coalesce(sum(got) FILTER (part = 'test' AND side = 'SELL'), 0) AS st FROM f GROUP BY 1),
    e AS (SELECT fold, ord, sum(sum(got)) OVER (PARTITION BY fold ORDER BY ord) AS equity FROM tt GROUP BY 1, 2), dd AS (SELECT fold, max(greatest(0, peak) - equity) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY fold ORDER BY ord) AS peak FROM e) GROUP BY 1),
    c AS (SELECT fold, step, count(*) AS n, sum(score) AS scores, count(*) FILTER (filled) AS done, count(*) FILTER (filled AND got > 0) AS wins, sum(got) AS total FROM tt GROUP BY 1, 2),
    cb AS (SELECT *, floor((sum(n) OVER (PARTITION BY fold ORDER BY step) - n) / greatest(1, floor(sum(n) OVER (PARTITION BY fold) / 5))) AS bucket FROM c),
    b AS (SELECT fold, bucket, abs(sum(scores) / sum(n) - sum(wins) / greatest(1, sum(done))) AS gap, coalesce(sum(total) / nullif(sum(done), 0), 0) AS mean FROM cb GROUP BY 1, 2),
    k AS (SELECT fold, count(*) FILTER (coalesce(before > mean, false)) = 0 AS monotonic, avg(gap) AS calibration_error FROM (SELECT *, lag(mean) OVER (PARTITION BY fold ORDER BY bucket) AS before FROM b) GROUP BY 1),
    pr AS (SELECT x.fold, count(*) AS pairs FROM tt x JOIN tt y ON x.fold = y.fold AND x.key = y.key AND x.day < y.day AND x.filled AND y.filled AND NOT (x.exit_day < y.entry_day OR y.exit_day < x.entry_day) GROUP BY 1),
    lk AS (SELECT fold, count(*) AS leaks FROM f WHERE EXISTS (SELECT 1 FROM ranges q JOIN days z ON z.ord = q.lo WHERE q.fold = f.fold AND q.part <> f.part AND q.lo > f.ord AND f.exit_day >= z.day) GROUP BY 1),
    tp AS (SELECT fold, count(*) FILTER (filled AND got > 0) / greatest(1, count(*) FILTER (filled)) AS precision_at_k FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, ord, key, side) AS place FROM tt) WHERE place <= 2 GROUP BY 1),
    x AS (SELECT fold, train_plans, train_expectancy, plans, filled, coalesce(total / nullif(filled, 0), 0) AS expectancy, total, coalesce(max_drawdown, 0) AS max_drawdown, turnover, coalesce(wins / nullif(filled, 0), 0) AS hit_rate, filled / greatest(plans, 1) AS coverage,
        (plans - filled) / greatest(plans, 1) AS no_trade_ratio, coalesce(precision_at_k, 0) AS precision_at_k, longs, coalesce(lt / nullif(longs, 0), 0) AS long_expectancy, shorts, coalesce(st / nullif(shorts, 0), 0) AS short_expectancy,
        CASE WHEN filled > 1 THEN {PHI.format(z=z("1.0"))} ELSE 0 END AS psr, CASE WHEN filled > 1 THEN {PHI.format(z=z("0.9"))} ELSE 0 END AS dsr, monotonic, calibration_error,
        CASE WHEN filled <= 1 THEN filled ELSE filled / (1 + coalesce(pairs, 0) / filled) END AS effective_size, coalesce(leaks, 0) AS leaks
        FROM g LEFT JOIN dd USING (fold) LEFT JOIN k USING (fold) LEFT JOIN pr USING (fold) LEFT JOIN lk USING (fold) LEFT JOIN tp USING (fold))"""


REASONS = """list_concat(list_concat(CASE WHEN expectancy <= 0 THEN ['non_positive_expectancy'] ELSE [] END, CASE WHEN greatest(psr, dsr) < 0.55 THEN ['low_psr', 'low_psr_or_dsr'] ELSE [] END),
    list_concat(CASE WHEN NOT monotonic THEN ['non_monotonic_bucket', 'non_monotonic_score_buckets'] ELSE [] END, CASE WHEN calibration_error > 0.25 THEN ['high_ece', 'high_calibration_error'] ELSE [] END))"""
ROUNDED = ("train_expectancy", "expectancy", "total", "max_drawdown", "turnover", "hit_rate", "coverage", "no_trade_ratio", "precision_at_k", "long_expectancy", "short_expectancy", "psr", "dsr", "calibration_error", "effective_size")
PLAIN = ("fold", "train_plans", "plans", "filled", "longs", "shorts", "monotonic", "leaks")
FOLD_ROWS = f"SELECT {', '.join(PLAIN)}, {', '.join(f'round({c}, 6) AS {c}' for c in ROUNDED)}, {REASONS} AS rejections FROM x"
PURGE, EMBARGO = D.purge_and_embargo(HORIZON)
WALKS = f"""sz AS (SELECT n, n // 2 AS size, greatest(1, least({HORIZON}, n - n // 2 - {PURGE} - {EMBARGO})) AS step FROM nd WHERE n >= 3),
    w AS (SELECT *, unnest(range(0, (n - size - {PURGE + EMBARGO} - step) // step + 1)) AS fold FROM sz WHERE n - size - {PURGE + EMBARGO} - step >= 0),
    ranges AS (SELECT fold, 'train' AS part, fold * step AS lo, fold * step + size AS hi FROM w UNION ALL SELECT fold, 'test', fold * step + size + {PURGE + EMBARGO}, fold * step + size + {PURGE + EMBARGO} + step FROM w)"""
GROUPS = 10
CHOICES = f"""ch AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS fold, i, j FROM range(0, {GROUPS}) a(i) JOIN range(0, {GROUPS}) b(j) ON i < j), tr AS (SELECT fold, i * n // {GROUPS} AS a, (i + 1) * n // {GROUPS} AS b, j * n // {GROUPS} AS c, (j + 1) * n // {GROUPS} AS d, n FROM ch, nd),
    al AS (SELECT fold, 'test' AS part, a AS lo, b AS hi FROM tr UNION ALL SELECT fold, 'test', c, d FROM tr UNION ALL SELECT fold, 'train', 0, a - {PURGE} FROM tr UNION ALL SELECT fold, 'train', b + {EMBARGO}, c - {PURGE} FROM tr UNION ALL SELECT fold, 'train', d + {EMBARGO}, n FROM tr), ranges AS (SELECT * FROM al WHERE lo < hi)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if c in ROUNDED else c for c in df.columns))


@query(f"{_fold_sql(WALKS)} {FOLD_ROWS}")
def walk_forward_metrics(t: Tables) -> DataFrame:
    """Walk-forward folds of reversal plans with purge and embargo from the horizon: the whole bundle of metrics, leaks and rejections."""
    return _rounded(D.evaluate(_plans(t), lambda days: D.walk_forward_ranges(days, HORIZON)))


@query(f"{_fold_sql(CHOICES)} {FOLD_ROWS}")
def combinatorial_metrics(t: Tables) -> DataFrame:
    """All 45 choices of two of ten blocks of days as test ranges."""
    return _rounded(D.evaluate(_plans(t), lambda days: D.combinatorial_ranges(days, GROUPS, 2, HORIZON)))


@query(f"""{_fold_sql(CHOICES)}, v AS (SELECT *, greatest(effective_size, longs + shorts, 1) AS w FROM x), ag AS (SELECT count(*) AS folds, sum(w * expectancy) / sum(w) AS expectancy, sum(w * psr) / sum(w) AS psr, sum(w * dsr) / sum(w) AS dsr,
    sum(w * calibration_error) / sum(w) AS calibration_error, sum(total) AS total, bool_and(monotonic) AS monotonic, sum(effective_size) AS effective_size, sum(leaks) = 0 AS leak_free FROM v)
    SELECT folds, {', '.join(f'round({c}, 6) AS {c}' for c in ('expectancy', 'psr', 'dsr', 'calibration_error', 'total', 'effective_size'))}, monotonic, leak_free, {REASONS} AS rejections FROM ag""")
def fold_aggregate(t: Tables) -> DataFrame:
    """The 45 folds in one row, weighted by effective size or trades."""
    return _rounded(D.aggregate(D.evaluate(_plans(t), lambda days: D.combinatorial_ranges(days, GROUPS, 2, HORIZON))))


TRAIN_END, TEST_START = datetime.date(2024, 1, 15), datetime.date(2024, 1, 21)
FEATURES = ("score", "reach", "ticks")


@query(f"""WITH {PLANS}, s AS (SELECT o.*, coalesce((high - low) / nullif(close, 0), 0) AS reach, ln(volume + 1) AS ticks, CASE side WHEN 'SELL' THEN 2 ELSE 0 END + CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS state, CASE WHEN filled THEN ret ELSE 0 END AS got FROM o JOIN bars USING (key, day)),
    t AS (SELECT * FROM s WHERE day <= DATE '{TRAIN_END}' AND exit_day <= DATE '{TRAIN_END}'), sc AS (SELECT {', '.join(f'avg({f}) AS m_{f}, greatest(1e-8, stddev_pop({f})) AS s_{f}' for f in FEATURES)} FROM t),
    p AS (SELECT state, [{', '.join(f'avg(({f} - m_{f}) / s_{f})' for f in FEATURES)}] AS vector FROM t, sc GROUP BY 1),
    c AS (SELECT greatest(0.1, least(10, regr_slope(CAST(got > 0 AS INT), score) * 10)) AS slope, ln(greatest(1e-6, avg(CAST(got > 0 AS INT))) / greatest(1e-6, 1 - avg(CAST(got > 0 AS INT)))) AS odds, avg(score) AS m, regr_slope(got, score) AS ev, avg(got) AS mg FROM t),
    z AS (SELECT s.*, [{', '.join(f'({f} - m_{f}) / s_{f}' for f in FEATURES)}] AS z FROM s, sc WHERE day >= DATE '{TEST_START}'),
    b AS (SELECT key, day, any_value(z) AS z, any_value(score) AS score, arg_max(p.state, [list_cosine_similarity(z, vector), -p.state]) AS match, max(list_cosine_similarity(z, vector)) AS similarity FROM z, p GROUP BY 1, 2)
    SELECT key, day, {', '.join(f'round(z[{i + 1}], 6) AS z_{f}' for i, f in enumerate(FEATURES))}, match, round(similarity, 6) AS similarity, round(1 / (1 + exp(-(slope * score + odds - slope * m))), 6) AS probability, round(ev * score + mg - ev * m, 6) AS expected FROM b, c""")
def frozen_scores(t: Tables) -> DataFrame:
    """Plans of the test days scored by what was fitted on the training days, stored under its hash and loaded again."""
    bars = _bars(t).select("key", "day", F.coalesce((F.col("high") - F.col("low")) / F.nullif(F.col("close"), F.lit(0.0)), F.lit(0.0)).alias("reach"), F.log(F.col("volume") + 1).alias("ticks"))
    state = F.when(F.col("side") == "SELL", 2).otherwise(0) + (F.col("score") >= 0.5).cast("int")
    rows = _plans(t).join(bars, ["key", "day"]).select("key", "day", F.col("exit_day").alias("outcome_day"), state.alias("state"), "score", F.when(F.col("filled"), F.col("ret")).otherwise(0.0).alias("ret"), "reach", "ticks")
    root = f"{shared_folder(t.spark)}/artifacts"
    name = A.fit(root, {"horizon_days": HORIZON, "fee": FEE, "features": list(FEATURES)}, rows, FEATURES, TRAIN_END, TEST_START)
    out = A.score(t.spark, root, name, rows.where(F.col("day") >= F.lit(TEST_START)))
    return out.select("key", "day", *(r6(F.get("z", F.lit(i))).alias(f"z_{f}") for i, f in enumerate(FEATURES)), "match", *(r6(c).alias(c) for c in ("similarity", "probability", "expected")))


SPACE = {"low": [i / 10 for i in range(9)], "width": [0.2, 0.4, 1.0], "sides": [0, 1, 2]}
SEARCH_FOLDS, DISCOVERY = 4, 0.8


def _search_sql() -> str:
    w, limits = P.WEIGHTS, P.LIMITS
    z = lambda share: f"(total / filled * {share}) / (sqrt(greatest((squares - 2 * (total / filled * {share}) * total + filled * (total / filled * {share}) * (total / filled * {share})) / (filled - 1), 1e-12)) / sqrt(filled))"
    phi = lambda share: f"CASE WHEN filled > 1 THEN greatest(0, least(1, {PHI.format(z='zz' + str(round(share * 10)))})) ELSE 0 END"
    return f"""WITH {PLANS}, p AS (SELECT r.*, CASE WHEN ord < floor(n * {DISCOVERY}) THEN CAST(floor(ord * {SEARCH_FOLDS} / floor(n * {DISCOVERY})) AS INT) ELSE -1 END AS fold FROM r, nd),
    grid AS (SELECT low, width, sides FROM (SELECT unnest([{', '.join(map(str, SPACE['low']))}])::DOUBLE AS low), (SELECT unnest([0.2, 0.4, 1.0])::DOUBLE AS width), (SELECT unnest([0, 1, 2]) AS sides)),
    mm AS (SELECT low, width, sides, f.fold, count(p.key) AS plans, count(*) FILTER (filled) AS filled, count(*) FILTER (filled AND got > 0) AS wins, coalesce(sum(score) FILTER (filled), 0) AS scores, coalesce(sum(got), 0) AS total, coalesce(sum(got * got), 0) AS squares, any_value(f.n) AS fold_plans
        FROM grid JOIN (SELECT fold, count(*) AS n FROM p GROUP BY 1) f ON true LEFT JOIN p ON p.fold = f.fold AND step >= round(low * 1000) AND step <= round((low + width) * 1000) AND (sides = 0 OR sides = 1 AND side = 'BUY' OR sides = 2 AND side = 'SELL') GROUP BY ALL),
    v AS (SELECT *, coalesce(total / nullif(filled, 0), 0) AS mean FROM mm), e AS (SELECT *, sum(total) OVER (PARTITION BY low, width, sides ORDER BY fold) AS equity FROM v WHERE fold >= 0),
    d AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY low, width, sides ORDER BY fold)) - equity AS fall FROM e),
    a AS (SELECT low, width, sides, sum(plans) AS plans, sum(filled) AS filled, sum(wins) AS wins, sum(scores) AS scores, sum(total) AS total, sum(squares) AS squares, sum(fold_plans) AS fold_plans, avg(mean) AS expectancy, stddev_pop(mean) AS spread, max(fall) AS drawdown FROM d GROUP BY ALL),
    b AS (SELECT *, CASE WHEN filled > 1 THEN greatest(-6, least(6, {z(1.0)})) END AS zz10, CASE WHEN filled > 1 THEN greatest(-6, least(6, {z(0.9)})) END AS zz9, filled / greatest(fold_plans, 1) AS coverage, (plans - filled) / greatest(plans, 1) AS no_trade_ratio, coalesce(abs(scores / nullif(filled, 0) - wins / nullif(filled, 0)), 0) AS calibration_error FROM a),
    c AS (SELECT *, {phi(1.0)} AS psr, {phi(0.9)} AS dsr FROM b),
    x AS (SELECT *, expectancy - {w['spread']} * spread - {w['calibration']} * calibration_error - {w['no_trade']} * no_trade_ratio - {w['drawdown']} * greatest(0, drawdown - {w['allowed_drawdown']}) AS value FROM c
        WHERE psr >= {limits['min_psr']} AND dsr >= {limits['min_dsr']} AND filled >= {limits['min_filled']} AND coverage >= {limits['min_coverage']})
    SELECT CAST(row_number() OVER (ORDER BY value DESC, low, sides, width) AS INT) AS place, low, width, sides, plans, filled, round(expectancy, 6) AS expectancy, round(spread, 6) AS spread, round(drawdown, 6) AS drawdown, round(calibration_error, 6) AS calibration_error,
    round(coverage, 6) AS coverage, round(value, 6) AS value, round(h.mean, 6) AS holdout_expectancy FROM x LEFT JOIN (SELECT low, width, sides, mean FROM v WHERE fold < 0) h USING (low, width, sides) QUALIFY place <= 10"""


@query(_search_sql())
def parameter_search(t: Tables) -> DataFrame:
    """The ten best of a grid of score ranges and sides by a constrained objective over four discovery folds, with their held-out mean.

    The search has as many trials as the grid has points, so its best are those of comparing all.
    """
    plans = _plans(t)
    days = D.trading_days(plans)
    early = F.floor(F.col("n") * DISCOVERY)
    fold = F.when(F.col("at") < early, F.floor(F.col("at") * SEARCH_FOLDS / early).cast("int")).otherwise(-1)
    days = days.crossJoin(days.agg(F.count("*").alias("n"))).select("day", fold.alias("fold"))  # one row
    prefixes = P.score_prefixes(plans.join(F.broadcast(days), "day"), F.col("fold"))  # a row a day
    path = f"{shared_folder(t.spark)}/search-{uuid.uuid4().hex}"
    found = P.search(t.spark, SPACE, P.score_range_trials(prefixes), 81, path)
    top = P.best(found, SPACE, 10)
    place = F.row_number().over(Window.orderBy(F.desc("value"), *sorted(SPACE)))  # ten rows
    rounded = ("expectancy", "spread", "drawdown", "calibration_error", "coverage", "value", "holdout_expectancy")
    return top.select(place.alias("place"), *SPACE, "plans", "filled", *(r6(c).alias(c) for c in rounded))


def _batch_sql() -> str:
    lists = ", ".join(f"list({c}) OVER past AS {c[0]}" for c in ("open", "high", "low", "close")) + ", list(volume::DOUBLE) OVER past AS v"
    return f"""WITH {BARS}, states AS (SELECT 0 AS run, * FROM bars WHERE day < (SELECT max(day) FROM bars) UNION ALL SELECT 1, * FROM bars),
    w AS (SELECT run, key, day, close, {lists} FROM states WINDOW past AS (PARTITION BY run, key ORDER BY day ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW)),
    p AS (SELECT * FROM w WHERE len(c) = {LOOKBACK} AND close >= list_max(c) AND c[1] > 0 AND close / nullif(c[1], 0) - 1 >= 0.05), {shape_steps("run, key, day")},
    done AS (SELECT key, CASE WHEN max(day) = (SELECT max(day) FROM bars) THEN 1 ELSE 0 END AS run FROM bars GROUP BY 1),
    x AS (SELECT q.key, q.day, q.run, e.key * 1000000 + date_diff('day', DATE '1970-01-01', e.day) AS match, list_cosine_similarity(q.v2, e.v2) AS sim, row_number() OVER (PARTITION BY q.key, q.day ORDER BY list_cosine_similarity(q.v2, e.v2) DESC, e.key, e.day) AS rank
        FROM k q JOIN done USING (key, run) JOIN k e ON e.run = q.run AND (e.key <> q.key OR e.day <> q.day))
    SELECT key, day, CAST(run AS INT) AS run, CAST(rank AS INT) AS rank, match, round(sim, 6) AS sim FROM x WHERE rank <= {NEAREST}"""


@query(_batch_sql())
def signal_batch(t: Tables) -> DataFrame:
    """The job over all bars but the last day's, then again over all, then once more: keys with a bar on the last day were done twice, none a third time."""
    job = J.signal_batch(t.spark, f"{shared_folder(t.spark)}/batch-{uuid.uuid4().hex}", LOOKBACK, 0.05, NEAREST)
    bars = held(_bars(t))
    last = bars.agg(F.max("day").alias("last"))
    job.run(bars.crossJoin(last).where("day < last").drop("last"))  # one row
    job.run(bars)
    if job.run(bars) != {"changed": 0, "gone": 0}:
        raise RuntimeError("a run over the same rows found changes")
    return job.table("matches").select("key", "day", F.col("run").cast("int").alias("run"), "rank", "match", r6("sim").alias("sim"))
