"""Walk-forward statistics of neighbours: what followed the most similar earlier paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import held
from . import shapes as H
from . import vectors as X
from .windows import by, frame


def path_windows(bars: DataFrame, lookback: int, exit_window: int) -> DataFrame:
    """``key, day, vector, entry, exit, exit_day, peak`` of every bar with ``lookback`` bars before and ``exit_window`` after it.

    The vector is the shape of the bars before; entry is the next open, exit the close ``exit_window`` bars on, peak the
    highest price from the bar itself to the exit.
    """
    bar = F.struct("open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))
    past = bars.withColumns({
        "path": F.collect_list(bar).over(frame(-lookback, -1)),  # `lookback` bars
        "entry": F.lead("open").over(by()), "exit": F.lead("close", exit_window).over(by()), "exit_day": F.lead("day", exit_window).over(by()),
        "peak": F.max("high").over(frame(0, exit_window)),
    }).where((F.size("path") == lookback) & F.col("exit_day").isNotNull())
    series = [F.col(f"path.{c}") for c in ("open", "high", "low", "close", "volume")]
    return past.select("key", "day", H.shape_v2(*series).alias("vector"), "entry", "exit", "exit_day", "peak")


def neighbour_signals(windows: DataFrame, asked: Column, k: int, least: float) -> DataFrame:
    """``key, day`` of the asked windows whose ``k`` nearest known windows all went up and whose nearest is similar enough.

    A window is known from its exit on: a query sees those whose exit day lies before its own. ``key`` is a whole number.
    """
    row = F.col("key").cast("long") * 1_000_000 + F.datediff("day", F.lit("1970-01-01"))
    pool = windows.select(row.alias("id"), F.col("vector").alias("v"), F.col("exit_day").alias("known"), (F.col("exit") > F.col("entry")).alias("up"))
    queries = windows.where(asked).select(row.alias("q"), F.col("vector").alias("qv"), F.col("day").alias("at"))
    top = X.top_similar(X.nearest(queries, pool, k, timed=True), ["q"], k)
    sure = top.groupBy("q").agg(F.count_if("up").alias("ups"), F.max("sim").alias("best")).where((F.col("ups") == k) & (F.col("best") >= least))
    at = F.date_add(F.lit("1970-01-01").cast("date"), F.pmod("q", F.lit(1_000_000)).cast("int"))
    return sure.select(F.floor(F.col("q") / 1_000_000).cast("long").alias("key"), at.alias("day"))


def neighbour_backtest(bars: DataFrame, asked: Column, lookback: int = 20, k: int = 5, exit_window: int = 5, least: float = 0.7, peak: float = 0.05) -> DataFrame:
    """One row for each key that ``asked`` holds for: signals, how many ended above their entry, how many reached the peak, profit and rates.

    Keys without a signal have zeros. An entry of zero or less never reaches the peak. Days from 1970 on.
    """
    windows = held(path_windows(bars, lookback, exit_window))
    hits = windows.join(neighbour_signals(windows, asked, k, least), ["key", "day"], "left_semi")
    gained = F.coalesce(F.when(F.col("entry") > 0, (F.col("peak") - F.col("entry")) / F.col("entry") >= peak), F.lit(False))
    by_key = hits.groupBy("key").agg(
        F.count("*").alias("signals"), F.count_if(F.col("exit") > F.col("entry")).alias("correct"), F.count_if(gained).alias("peaks"),
        F.sum("entry").alias("invested"), F.sum(F.col("exit") - F.col("entry")).alias("profit"),
    )
    spans = bars.where(asked).groupBy("key").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"))
    out = spans.join(by_key, "key", "left").fillna(0, ["signals", "correct", "peaks"]).fillna(0.0, ["invested", "profit"])
    share = lambda n: F.when(F.col("signals") > 0, F.col(n) / F.col("signals")).otherwise(0.0)
    rate = F.when(F.col("invested") > 0, F.col("profit") / F.col("invested")).otherwise(0.0)
    return out.select("key", "from_day", "to_day", "signals", "correct", "peaks", "profit", share("correct").alias("win_rate"), share("peaks").alias("peak_rate"), rate.alias("return_rate"))
