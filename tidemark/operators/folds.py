"""Walk-forward and combinatorial folds as rows of day ranges, evaluated together.

``outcomes`` has a row for each plan: ``key, day, side`` (BUY or SELL), ``score``, ``filled``, ``ret`` (0 if unfilled),
``entry_day, exit_day, notional``. Rows are read once and added up by day, by day and score step, and by day and exit
day; folds only read these sums. Moments of a range are the difference of two prefix sums over days, so many folds cost
no more than one. All tables after the first pass have at most as many rows as days times steps.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import held
from .relational import top_per
from .statistics import normal_cdf

#: Scores are taken in steps of one part in STEPS; plans of one step are never put in two buckets.
STEPS = 1_000
MOMENTS = ("plans", "filled", "wins", "total", "squares", "longs", "long_total", "shorts", "short_total", "turnover")


def purge_and_embargo(horizon: int, overlap: float = 1.0) -> tuple[int, int]:
    """Days left out before and after a test range for outcomes of ``horizon`` days."""
    horizon = max(1, int(horizon))
    return max(1, horizon - 1), max(1, math.ceil(horizon * max(0.0, overlap)))


def _range(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _ranges(folds: DataFrame, n: str) -> DataFrame:
    """``fold, part, lo, hi`` of folds with arrays ``train`` and ``test``, cut to the days there are; empty ranges go."""
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("ranges")) for p in ("train", "test")))
    rows = folds.select("fold", n, F.explode(parts).alias("p")).select("fold", n, "p.part", F.explode("p.ranges").alias("r"))
    return rows.select("fold", "part", F.greatest("r.lo", F.lit(0)).alias("lo"), F.least("r.hi", F.col(n)).alias("hi")).where("lo < hi")


def walk_forward_ranges(days: DataFrame, horizon: int, overlap: float = 1.0) -> DataFrame:
    """``fold, part, lo, hi``: half of the days train, then purge and embargo, then a test of ``horizon`` days; each fold a test further on.

    Ranges are half-open over the ordinals ``at`` of ``days``. Fewer than three days give no fold.
    """
    purge, embargo = purge_and_embargo(horizon, overlap)
    n = days.agg(F.count("*").cast("int").alias("n")).where("n >= 3")
    train = F.floor(F.col("n") / 2).cast("int")
    test = F.greatest(F.lit(1), F.least(F.lit(horizon), F.col("n") - train - purge - embargo))
    sized = n.select("n", train.alias("size"), test.alias("step")).withColumn("folds", F.floor((F.col("n") - F.col("size") - purge - embargo - F.col("step")) / F.col("step")).cast("int") + 1)
    folds = sized.where("folds > 0").withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)))
    start = F.col("fold") * F.col("step")
    tested = start + F.col("size") + purge + embargo
    return _ranges(folds.select("fold", "n", F.array(_range(start, start + F.col("size"))).alias("train"), F.array(_range(tested, tested + F.col("step"))).alias("test")), "n")


def combinatorial_ranges(days: DataFrame, groups: int, tests: int, horizon: int, overlap: float = 1.0) -> DataFrame:
    """``fold, part, lo, hi`` for every choice of ``tests`` of ``groups`` blocks of days as test ranges.

    The rest trains, less the purge before and the embargo after each test range.
    """
    purge, embargo = purge_and_embargo(horizon, overlap)
    rows = []
    for fold, chosen in enumerate(combinations(range(groups), tests)):
        begin, shift = 0, 0
        for g in chosen:  # ascending, so a gap runs from the last test's embargo to the next one's purge
            rows += [(fold, "train", begin, shift, g, -purge), (fold, "test", g, 0, g + 1, 0)]
            begin, shift = g + 1, embargo
        rows.append((fold, "train", begin, shift, groups, 0))
    folds = days.sparkSession.createDataFrame(rows, "fold int, part string, a int, plus int, b int, more int")  # of the parameters alone
    edge = lambda g, by: F.floor(F.col(g) * F.col("n") / groups).cast("int") + F.col(by)
    cut = folds.crossJoin(F.broadcast(days.agg(F.count("*").alias("n"))))  # one row
    cut = cut.select("fold", "part", F.greatest(edge("a", "plus"), F.lit(0)).alias("lo"), F.least(edge("b", "more"), F.col("n").cast("int")).alias("hi"))
    return cut.where("lo < hi")


def trading_days(outcomes: DataFrame) -> DataFrame:
    """``day, at``: the days of plans and their ordinals from 0."""
    return outcomes.select("day").where("day IS NOT NULL").distinct().withColumn("at", F.row_number().over(Window.orderBy("day")) - 1)  # a row a day


class Daily:
    """What a set of folds needs to know of the outcomes, by day."""

    def __init__(self, outcomes: DataFrame, top_k: int = 2):
        done = F.col("filled")
        got = F.when(done, F.coalesce("ret", F.lit(0.0))).otherwise(0.0)
        rows = outcomes.select("key", "day", "side", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("filled", F.lit(False)).alias("filled"), "ret", "entry_day", "exit_day", "notional")
        rows = rows.withColumns({"ret": got, "step": F.round(F.col("score") * STEPS).cast("int")})
        # one pass: everything else adds up these rows
        sums = {
            "n": F.count("*"), "scores": F.sum("score"), "filled": F.count_if("filled"), "wins": F.count_if(F.col("filled") & (F.col("ret") > 0)), "total": F.sum("ret"),
            "squares": F.sum(F.col("ret") * F.col("ret")), "turnover": F.sum(F.when(F.col("filled"), F.coalesce("notional", F.lit(0.0))).otherwise(0.0)),
        }
        base = held(rows.where("day IS NOT NULL").groupBy("key", "day", "side", "step", "entry_day", "exit_day", "filled").agg(*(x.alias("done" if c == "filled" else c) for c, x in sums.items())))
        self.days = held(trading_days(base))
        at = F.broadcast(self.days)  # a row a day
        held_rows = base.withColumn("longs", F.when(F.col("side") == "BUY", F.col("done")).otherwise(0)).withColumn("shorts", F.when(F.col("side") == "SELL", F.col("done")).otherwise(0))
        by_day = held_rows.groupBy("day").agg(
            F.sum("n").alias("plans"), F.sum("done").alias("filled"), F.sum("wins").alias("wins"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.sum("longs").alias("longs"),
            F.sum(F.when(F.col("side") == "BUY", F.col("total")).otherwise(0.0)).alias("long_total"), F.sum("shorts").alias("shorts"), F.sum(F.when(F.col("side") == "SELL", F.col("total")).otherwise(0.0)).alias("short_total"), F.sum("turnover").alias("turnover"),
        )
        self.by_day = held(by_day.join(at, "day"))
        self.steps = held(base.groupBy("day", "step").agg(*(F.sum(c).alias(c) for c in ("n", "scores", "done", "wins", "total"))).join(at, "day").drop("day"))
        self.exits = held(base.where("exit_day IS NOT NULL").groupBy("day", "exit_day").agg(F.sum("n").alias("n")).join(at, "day").drop("day"))
        self.pairs = held(_overlapping(base.where("filled AND entry_day IS NOT NULL AND exit_day IS NOT NULL").join(at, "day")))
        best = top_per(rows.where("day IS NOT NULL"), ["day"], [F.desc("score"), F.col("key"), F.col("side")], top_k)
        self.best = held(best.select("day", "score", "key", "side", "filled", "ret").join(at, "day"))
        self.top_k = top_k

    def prefixes(self) -> DataFrame:
        """``at`` from 0 to the number of days, with the sums of all earlier days."""
        before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
        after = self.by_day.select((F.col("at") + 1).alias("at"), *(F.sum(c).over(before).alias(c) for c in MOMENTS))
        kinds = dict(after.dtypes)
        return self.days.sparkSession.range(1).select(F.lit(0).alias("at"), *(F.lit(0).cast(kinds[c]).alias(c) for c in MOMENTS)).unionByName(after)


def _overlapping(rows: DataFrame) -> DataFrame:
    """``a, b, n``: pairs of filled plans of one key whose times overlap, by the ordinals of their days, ``a`` not after ``b``.

    Plans of a key with the same days are one row with a count, so a key that holds many plans gives few rows; of
    these, each meets those that start before it ends, found by the days it spans.
    """
    span = rows.groupBy("key", "at", "entry_day", "exit_day").agg(F.sum("n").alias("n")).where("exit_day >= entry_day")
    left = span.select("key", F.col("at").alias("a"), F.col("entry_day").alias("a0"), F.col("exit_day").alias("a1"), F.col("n").alias("an"), F.explode(F.sequence("entry_day", "exit_day")).alias("on"))
    right = span.select("key", F.col("at").alias("b"), F.col("entry_day").alias("b0"), F.col("exit_day").alias("b1"), F.col("n").alias("bn"), F.col("entry_day").alias("on"))
    # each unordered pair once: b begins on a day that a spans, and of equal beginnings the row that is not smaller
    met = left.join(right, ["key", "on"]).where((F.col("b0") > F.col("a0")) | (F.struct("a1", "a") <= F.struct("b1", "b")))
    same = (F.col("a") == F.col("b")) & (F.col("a0") == F.col("b0")) & (F.col("a1") == F.col("b1"))
    n = F.when(same, F.expr("an * (an - 1) DIV 2")).otherwise(F.col("an") * F.col("bn"))
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(n).alias("n"))


def evaluate(outcomes: DataFrame, ranges, symbols: int | None = None, buckets: int = 5, top_k: int = 2) -> DataFrame:
    """One row a fold: training size and mean, and the metrics of its test ranges with the reasons to reject it.

    ``ranges`` makes the folds' ranges from the days (:func:`walk_forward_ranges`, :func:`combinatorial_ranges`).
    ``leaks`` counts plans of one part whose outcome ends in the other part's time. Equity moves once a day.
    Coverage is of ``symbols``, else of the test's plans. Null scores and returns are zero, a null ``filled`` is false,
    rows without a day take no part; no outcomes give no fold.
    """
    daily = Daily(outcomes, top_k)
    folds = held(ranges(daily.days))
    sums = daily.prefixes()
    lo, hi = (sums.select(F.col("at").alias(e), *(F.col(c).alias(f"{e}_{c}") for c in MOMENTS)) for e in ("lo", "hi"))
    cut = folds.join(lo, "lo").join(hi, "hi").groupBy("fold")
    part = lambda p, c: F.sum(F.when(F.col("part") == p, F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(0))
    out = cut.agg(*(part("test", c).alias(c) for c in MOMENTS), part("train", "plans").alias("train_plans"), part("train", "filled").alias("train_filled"), part("train", "total").alias("train_total"))
    members = held(folds.select("fold", "part", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("at")).distinct())
    tested = members.where("part = 'test'").drop("part")
    for more in (_drawdown(daily, tested), _calibration(daily, tested, buckets), _sample(daily, tested), _leaks(daily, folds, members), _precision(daily, tested)):
        out = out.join(more, "fold", "left")
    return _metrics(out.fillna(0), symbols).orderBy("fold")


def _drawdown(daily: Daily, tested: DataFrame) -> DataFrame:
    """Deepest fall of each fold's summed returns below their highest point or their start."""
    before = Window.partitionBy("fold").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    run = tested.join(daily.by_day.select("at", "total"), "at").withColumn("equity", F.sum("total").over(before))
    fall = F.greatest(F.lit(0.0), F.max("equity").over(before)) - F.col("equity")
    return run.withColumn("fall", fall).groupBy("fold").agg(F.max("fall").alias("max_drawdown"))


def _calibration(daily: Daily, tested: DataFrame, buckets: int) -> DataFrame:
    """Whether expectancy rises over buckets of the score, and the mean gap of score and precision."""
    cells = tested.join(daily.steps, "at").groupBy("fold", "step").agg(*(F.sum(c).alias(c) for c in ("n", "scores", "done", "wins", "total")))
    order = Window.partitionBy("fold").orderBy("step")  # a row a score step
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy("fold")) / buckets))
    rows = cells.withColumn("bucket", F.floor(before / size)).groupBy("fold", "bucket").agg(*(F.sum(c).alias(c) for c in ("n", "scores", "done", "wins", "total")))
    mean = F.when(F.col("done") > 0, F.col("total") / F.col("done")).otherwise(0.0)
    rows = rows.withColumns({"mean": mean, "gap": F.abs(F.col("scores") / F.col("n") - F.col("wins") / F.greatest("done", F.lit(1)))})
    falls = F.lag("mean").over(Window.partitionBy("fold").orderBy("bucket")) > F.col("mean")
    return rows.withColumn("falls", F.coalesce(falls, F.lit(False))).groupBy("fold").agg((F.count_if("falls") == 0).cast("int").alias("rising"), F.avg("gap").alias("calibration_error"))


def _sample(daily: Daily, tested: DataFrame) -> DataFrame:
    both = daily.pairs.join(tested.withColumnRenamed("at", "a"), "a").join(tested.withColumnRenamed("at", "b"), ["fold", "b"])
    return both.groupBy("fold").agg(F.sum("n").alias("pairs"))


def _leaks(daily: Daily, folds: DataFrame, members: DataFrame) -> DataFrame:
    """Plans whose outcome ends on or after the first day of a range of the other part that begins after them."""
    starts = folds.join(daily.days.withColumnsRenamed({"at": "lo", "day": "first"}), "lo").groupBy("fold", F.when(F.col("part") == "test", "train").otherwise("test").alias("part")).agg(F.collect_list(F.struct("lo", "first")).alias("starts"))
    rows = members.join(daily.exits, "at").join(starts, ["fold", "part"])
    late = F.exists("starts", lambda s: (s["lo"] > F.col("at")) & (F.col("exit_day") >= s["first"]))
    return rows.where(late).groupBy("fold").agg(F.sum("n").alias("leaks"))


def _precision(daily: Daily, tested: DataFrame) -> DataFrame:
    top = top_per(tested.join(daily.best, "at"), ["fold"], [F.desc("score"), F.col("at"), F.col("key"), F.col("side")], daily.top_k)
    return top.groupBy("fold").agg((F.count_if(F.col("filled") & (F.col("ret") > 0)) / F.greatest(F.count_if("filled"), F.lit(1))).alias("precision_at_k"))


def sharpe(share: float) -> Column:
    """Probability that the mean return, times ``share``, is above zero: from count, sum and sum of squares."""
    n = F.nullif(F.col("filled"), F.lit(0))  # the arguments of a Python function are worked out for every row
    mu = F.col("total") / n * share
    var = (F.col("squares") - 2 * mu * F.col("total") + n * mu * mu) / F.nullif(n - 1, F.lit(0))
    return F.when(F.col("filled") > 1, normal_cdf(mu / (F.sqrt(F.greatest(var, F.lit(1e-12))) / F.sqrt(n)))).otherwise(0.0)


def _metrics(rows: DataFrame, symbols: int | None) -> DataFrame:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    base = F.lit(float(symbols)) if symbols else F.greatest("plans", F.lit(1))
    n = F.col("filled")
    rows = rows.withColumns({
        "expectancy": ratio("total", "filled"), "train_expectancy": ratio("train_total", "train_filled"), "hit_rate": ratio("wins", "filled"), "coverage": F.when(base > 0, n / base).otherwise(0.0),
        "no_trade_ratio": (F.col("plans") - n) / F.greatest("plans", F.lit(1)), "long_expectancy": ratio("long_total", "longs"), "short_expectancy": ratio("short_total", "shorts"), "psr": sharpe(1.0), "dsr": sharpe(0.9),
        "monotonic": F.col("rising") == 1, "effective_size": F.when(n <= 1, n.cast("double")).otherwise(n / (1 + F.col("pairs") / n)),
    })
    keep = ("fold", "train_plans", "train_expectancy", "plans", "filled", "expectancy", "total", "max_drawdown", "turnover", "hit_rate", "coverage", "no_trade_ratio", "precision_at_k")
    keep += ("longs", "long_expectancy", "shorts", "short_expectancy", "psr", "dsr", "monotonic", "calibration_error", "effective_size", "leaks")
    return rows.select(*keep, rejections())


def rejections() -> Column:
    """Why a fold or an aggregate is not good enough: an array of reasons."""
    checks = (
        (F.col("expectancy") <= 0, ("non_positive_expectancy",)), (F.greatest("psr", "dsr") < 0.55, ("low_psr", "low_psr_or_dsr")),
        (~F.col("monotonic"), ("non_monotonic_bucket", "non_monotonic_score_buckets")), (F.col("calibration_error") > 0.25, ("high_ece", "high_calibration_error")),
    )
    none = F.array().cast("array<string>")
    return F.concat(*(F.when(c, F.array(*map(F.lit, names))).otherwise(none) for c, names in checks)).alias("rejections")


def aggregate(folds: DataFrame) -> DataFrame:
    """One row of all folds, each weighted with its effective size or its trades, whichever is more, and 1 at least."""
    w = F.greatest("effective_size", (F.col("longs") + F.col("shorts")).cast("double"), F.lit(1.0))
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum(w)).alias(c)
    out = folds.agg(
        F.count("*").alias("folds"), *(mean(c) for c in ("expectancy", "psr", "dsr", "calibration_error")), F.sum("total").alias("total"), F.bool_and("monotonic").alias("monotonic"),
        F.sum("effective_size").alias("effective_size"), (F.sum("leaks") == 0).alias("leak_free"),
    )
    return out.where("folds > 0").select("*", rejections())
