"""Buy plans of an opening session: budgets, ladder, risk and earnings in one dataflow, where every candidate ends as legs or one reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, round_to_tick
from .kernels import LadderTuning, allocate, ladder

#: fixed values: limits of a multiplied distance, and the multiplier of a day with earnings
MOST_DISCOUNT, LEAST_MARKUP_CAP, MOST_MARKUP, EARNINGS = 0.95, 1.5, 1.8, 2.0


def moved_out(price: Column, limit: Column, multiplier: Column, market: str = "US", side: str = "BUY") -> Column:
    """A limit whose distance from the price is multiplied, on a tick; multipliers of 1 or less, and prices or limits that are none, change nothing."""
    share = limit / F.nullif(price, F.lit(0.0))
    if side == "SELL":
        to = price * (1 + clip(clip(share - 1, 0, LEAST_MARKUP_CAP) * multiplier, 0, MOST_MARKUP))
    else:
        to = price * (1 - clip(clip(1 - share, 0, MOST_DISCOUNT) * multiplier, 0, MOST_DISCOUNT))
    return F.when((multiplier > 1) & (price > 0) & (limit > 0), round_to_tick(to, market, "")).otherwise(limit)


def candidate_codes(c: DataFrame, cash: float, market: str = "US", least_legs: int = 3, micro: bool = True, **rules: float) -> DataFrame:
    """``batch, id, code, budget, units`` of candidates ``batch, id, price, atr_pct, signal``: what each is bought with, or why it is not.

    The first reason that holds stands: INVALID without a price or a signal, BUDGET_ALLOCATION without a budget
    (see :func:`kernels.allocate`, which takes ``rules``), BUDGET when that buys nothing at the first limit, GRANULARITY
    when it buys fewer than ``least_legs`` and ``micro`` is off, else OK. A null range is 0.05. Ids are unique in a batch.
    """
    c = c.select("batch", "id", F.col("price").cast("double").alias("price"), F.coalesce(F.col("atr_pct").cast("double"), F.lit(0.05)).alias("atr_pct"), F.coalesce(F.col("signal").cast("double"), F.lit(0.0)).alias("signal"))
    valid = F.coalesce(F.col("price") > 0, F.lit(False)) & (F.col("signal") > 0) & F.col("id").isNotNull()
    budgets = allocate(c.withColumn("price", F.coalesce("price", F.lit(0.0))), cash, legs=least_legs, market=market, **rules)  # counts all of a batch
    rows = c.join(budgets.select(F.col("batch").alias("b"), F.col("id").alias("i"), "budget"), F.col("batch").eqNullSafe(F.col("b")) & (F.col("id") == F.col("i")), "left").drop("b", "i")
    first = round_to_tick(F.col("price") * (1 - F.greatest(F.lit(0.012), 0.4 * F.col("atr_pct"))), market, "")
    units = F.floor(F.coalesce("budget", F.lit(0.0)) / F.greatest(first, F.lit(1e-6))).cast("long")
    rows = rows.withColumn("units", F.when(valid, units).otherwise(0))
    code = (
        F.when(~valid, "INVALID").when(F.col("budget").isNull(), "BUDGET_ALLOCATION").when(F.col("units") <= 0, "BUDGET")
        .when((F.col("units") < least_legs) & F.lit(not micro), "GRANULARITY").otherwise("OK")
    )
    return rows.select("batch", "id", code.alias("code"), "budget", "units")


def buy_plans(c: DataFrame, cash: float, market: str = "US", tuning: LadderTuning | None = None, least_legs: int = 3, micro: bool = True, **rules: float) -> DataFrame:
    """``batch, id, code, budget, leg, limit_price, quantity``: a row for each leg, or one row with the reason and no leg.

    Beside what :func:`candidate_codes` reads, ``c`` may have the ladder's hints (``gain, label, adverse, wanted``),
    a news ``multiplier`` and ``earnings`` (reports that day). Ladders are as the signal alone makes them; then each
    leg's distance grows with the news, then with the earnings. A candidate whose ladder is empty ends as NO_LEGS. A key
    of a batch is no single task: legs are worked out candidate by candidate.
    """
    codes = candidate_codes(c, cash, market, least_legs, micro, **rules)
    at = F.struct("batch", "id")
    hints = [x for x in ("gain", "label", "adverse", "wanted") if x in c.columns]
    asked = c.select(at.alias("key"), F.col("price").cast("double").alias("price"), F.col("signal").cast("double").alias("strength"), *hints)
    asked = asked.join(codes.where("code = 'OK'").select(at.alias("key"), F.col("units").alias("quantity")), "key").withColumnRenamed("key", "id")
    legs = ladder(asked, market, "BUY", tuning)
    news = F.coalesce(F.col("multiplier").cast("double"), F.lit(1.0)) if "multiplier" in c.columns else F.lit(1.0)
    reports = F.coalesce(F.col("earnings"), F.lit(False)) if "earnings" in c.columns else F.lit(False)
    facts = c.select(at.alias("id"), F.col("price").cast("double").alias("price"), news.alias("news"), F.when(reports, EARNINGS).otherwise(1.0).alias("day"))
    legs = legs.join(facts, "id")
    once = moved_out(F.col("price"), F.col("limit_price"), F.col("news"), market)
    legs = legs.withColumn("limit_price", once).withColumn("limit_price", moved_out(F.col("price"), F.col("limit_price"), F.col("day"), market))
    legs = legs.select("id.batch", "id.id", "leg", "limit_price", "quantity")
    return end_of_each(codes, legs)


def end_of_each(codes: DataFrame, legs: DataFrame) -> DataFrame:
    """Legs beside their candidate's code and budget; candidates without legs have one row with their reason."""
    made = legs.select(F.col("batch").alias("b"), F.col("id").alias("i"), "leg", "limit_price", "quantity")
    rows = codes.join(made, F.col("batch").eqNullSafe(F.col("b")) & (F.col("id") == F.col("i")), "left")
    code = F.when((F.col("code") == "OK") & F.col("leg").isNull(), "NO_LEGS").otherwise(F.col("code"))
    return rows.select("batch", "id", code.alias("code"), "budget", "leg", "limit_price", "quantity")
