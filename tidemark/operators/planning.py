"""Live planning rules: headline risk, sell intensity, ratchets, stops and skip codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, logistic, round_to_tick


def buy_risk_multiplier(regime: Column, risk: Column, confidence: Column, most: float = 3.0) -> Column:
    """Rises smoothly from 1 with tail risk and a falling regime."""
    raw = 0.7 * clip(risk / 100.0, 0, 1) + 0.3 * clip(-regime / 100.0, 0, 1)
    return F.round(clip(1 + (most - 1) * (0.55 * raw + 0.45 * F.pow(raw, F.lit(1.6))) * (0.55 + 0.45 * clip(confidence, 0, 1)), 1, most), 4)


def sell_markup(regime: Column, confidence: Column, most: float = 1.8) -> Column:
    """Steps up with a rising regime."""
    base = F.when(regime <= 20, 1.0).when(regime <= 45, 1.12).when(regime <= 65, 1.28).when(regime <= 80, 1.45).otherwise(1.6)
    return F.round(clip(1 + (base - 1) * (0.7 + 0.3 * clip(confidence, 0, 1)), 1, most), 4)


def sell_intensity(gain: Column, signal: Column, base: float = 0.0, gain_scale: float = 0.03, gain_weight: float = 2.2, trend_weight: float = 3.0, fall_scale: float = 0.05, fall_weight: float = 2.0, least: float = 0.15, most: float = 1.0) -> Column:
    raw = base + gain_weight * F.tanh(gain / gain_scale) - trend_weight * signal - fall_weight * F.greatest(F.lit(0.0), -gain) / fall_scale
    return clip(logistic(raw), least, most)


def rescale_legs(legs: DataFrame, intensity: Column) -> DataFrame:
    """Quantities of each order's legs (``id, leg, quantity``) brought to a share of their sum by largest remainder."""
    own = Window.partitionBy("id")
    total = F.sum("quantity").over(own)
    goal = F.bround(total * intensity).cast("long")
    out = legs.withColumns({"total": total, "goal": F.greatest(F.lit(0), F.least(goal, total))}).where("goal > 0")
    exact = F.col("quantity") / F.col("total") * F.col("goal")
    out = out.withColumns({"exact": exact, "whole": F.floor(exact)})
    rank = F.row_number().over(own.orderBy(F.desc(F.col("exact") - F.col("whole")), "leg"))
    out = out.withColumn("quantity", (F.col("whole") + F.when(rank <= F.col("goal") - F.sum("whole").over(own), 1).otherwise(0)).cast("long"))
    return out.where("quantity > 0").drop("total", "goal", "exact", "whole")


def ratchet(old: Column, price: Column, most: float | Column = 0.3, fade: float = 0.03) -> Column:
    """An old limit moved towards the price, far limits hardly at all."""
    return old + (price - old) * most * F.exp(-F.abs(price - old) / F.greatest(price, F.lit(1e-6)) / fade)


def net_strength(p_up: Column, p_down: Column, up: Column, down: Column, scale: float = 0.02) -> Column:
    return clip((p_up * up - p_down * down) / scale, -1, 1)


def active_score(p_up: Column, confidence: Column, liquidity_pct: Column, price: Column, entry: Column, pending: Column, heat: Column) -> Column:
    distance = F.when(price != 0, F.abs((price - entry) / price)).otherwise(0.0)
    return 0.30 * p_up + 0.30 * confidence + 0.15 * liquidity_pct / 100 + 0.10 * distance + 0.10 * F.when(pending, 1.0).otherwise(0.0) + 0.05 * F.least(heat / 10, F.lit(1.0))


def action_code(signal: Column, least: float = 0.6) -> Column:
    """BUY also for strongly negative signals: the size of the signal counts, not its sign."""
    return F.when(signal.isNull(), "NO_ANN").when(F.isnan(signal), "ERROR").when(F.abs(signal) < least, "LOW_SIGNAL").otherwise("BUY")


def buy_code(price: Column, budget: Column, atr_pct: Column, market: str = "US", least_units: int = 2, micro: bool = False) -> Column:
    """Why a budgeted candidate is skipped, or OK."""
    limit = round_to_tick(price * (1 - F.greatest(F.lit(0.012), 0.4 * atr_pct)), market, "BUY")
    units = F.floor(budget / F.greatest(limit, F.lit(1e-6)))
    thin = F.lit(False) if micro else units < least_units
    return F.when(F.coalesce(price, F.lit(0.0)) <= 0, "INVALID").when(F.coalesce(budget, F.lit(0.0)) <= 0, "INVALID").when(units <= 0, "BUDGET").when(thin, "GRANULARITY").otherwise("OK")


def intraday_code(strength: Column, price: Column, blocked: Column, cap: Column, predictions: Column, held: Column, least: float = 0.3) -> Column:
    """What a prediction asks for; strengths under the threshold hold, so a held position is only sold on a negative one."""
    units = F.floor(cap / predictions / price)
    return (
        F.when(price <= 0, "OTHER").when(F.abs(strength) < least, "HOLD").when((strength > 0) & blocked, "RISK").when((strength > 0) & (units <= 0), "BUDGET")
        .when(strength > 0, "BUY").when(held, "SELL").otherwise("NO_POSITION")
    )


def matured(held_days: Column, breach_day: Column, default: int = 12) -> Column:
    return held_days >= F.coalesce(breach_day, F.lit(default))


def keep_newest_leg(legs: DataFrame, symbol: str = "symbol", at: str = "created_at", tie: str = "id") -> DataFrame:
    """Near the close only the newest leg of a symbol stays."""
    order = Window.partitionBy(symbol).orderBy(F.desc(at), F.desc(tie))
    return legs.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
