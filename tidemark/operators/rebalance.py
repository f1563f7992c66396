"""Standing limit legs moved with predictions, one way at a time, and carried over versions of a prediction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions.scalars import round_to_tick
from ..session import held
from .planning import ratchet


@dataclass(frozen=True)
class RatchetTuning:
    """fixed values: the published defaults, as shares of the price"""

    least_strength: float = 0.25
    trigger_discount: float = 0.010
    trigger_premium: float = 0.010
    least_premium: float = 0.002
    up_step: float = 0.003
    up_step_most: float = 0.006
    sell_up_step: float = 0.003
    sell_down_step: float = 0.003
    sell_down_step_most: float = 0.012
    per_expected: float = 0.5
    unit: float = 0.01
    up_most: float = 0.7
    down_most: float = 0.5
    fade: float = 0.03


def nearest_legs(legs: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts`` (a row a symbol, with its ``price``) and the limits nearest to it: of all buys, all sells, and the sells above it; ties to the smaller leg.

    One aggregation with partial sums, so a symbol that holds many legs is no single task.
    """
    near = legs.join(facts.select("symbol", "price"), "symbol").withColumn("gap", F.struct(F.abs(F.col("price") - F.col("limit_price")), F.col("leg_id")))
    of = lambda holds: F.min_by(F.when(holds, F.col("limit_price")), F.when(holds, F.col("gap")))
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    found = near.groupBy("symbol").agg(of(buy).alias("near_buy"), of(sell).alias("near_sell"), of(sell & (F.col("limit_price") > F.col("price"))).alias("near_above"))
    return facts.join(found, "symbol")


def _move(t: RatchetTuning, market: str) -> Column:
    """``new_price, action`` of a leg beside its symbol's facts; null where the leg stays. Only the case that applies is worked out, once."""
    price, old, s = F.col("price"), F.col("limit_price"), F.col("strength")
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    up, down = F.greatest(F.lit(0.0), F.col("expected_up")), F.greatest(F.lit(0.0), F.col("expected_down"))
    step = lambda base, more, most: F.least(F.lit(most), F.lit(base) + t.per_expected * more)
    rises, falls = s >= t.least_strength, s <= -t.least_strength
    sell_down = falls & sell & (old > price) & ((F.col("near_above") - price) / price >= max(t.least_premium, 0.001))
    share = (
        F.when(rises & buy & ((price - F.col("near_buy")) / price >= t.trigger_discount), F.least(step(t.up_step, up, t.up_step_most) / t.unit, F.lit(t.up_most)))
        .when(rises & sell & ((F.col("near_sell") - price) / price <= t.trigger_premium), F.least((t.sell_up_step + t.per_expected * up) / t.unit, F.lit(t.up_most)))
        .when(falls & buy & (old < price), -F.least(step(t.up_step, down, t.up_step_most) / t.unit, F.lit(t.down_most)))
        .when(sell_down, -F.least(step(t.sell_down_step, down, t.sell_down_step_most) / t.unit, F.lit(t.down_most)))
    )
    tick = lambda x: round_to_tick(x, market, "")

    def taken(x: Column) -> Column:
        side = F.when(buy, x < price).otherwise(x > price)
        way = F.when(rises, x > old).otherwise(x < old)
        return F.when(side & way, F.struct(x.alias("new_price"), F.when(rises, "RATCHET_UP").otherwise("RATCHET_DOWN").alias("action")))

    lowest = lambda x: F.when(sell_down, F.greatest(x, tick(price * 1.0001))).otherwise(x)
    return V.once(share, lambda a: F.when(a.isNotNull(), V.once(tick(ratchet(old, price, a, t.fade)), lambda x: V.once(lowest(x), taken))))


_MOVES = "array<struct<version: int, old_price: double, new_price: double, action: string>>"


def carried(legs: DataFrame, predictions: DataFrame, versions: Sequence[int], market: str = "US", tuning: RatchetTuning | None = None) -> DataFrame:
    """The legs as they stand after the versions in turn, with their ``moves`` in order (see :func:`rebalance`).

    A leg carries its moves along, so a version is one join by symbol and none by leg.
    """
    t, now = tuning or RatchetTuning(), held(legs.withColumns({"limit_price": F.col("limit_price").cast("double"), "moves": F.array().cast(_MOVES)}))
    names = now.columns
    for v in versions:
        facts = predictions.where((F.col("version") == v) & (F.col("price") > 0)).select("symbol", F.col("price").cast("double"), "strength", F.coalesce("expected_up", F.lit(0.0)).alias("expected_up"), F.coalesce("expected_down", F.lit(0.0)).alias("expected_down"))
        facts = facts.where(F.abs("strength") >= t.least_strength)
        near = nearest_legs(now.where("limit_price > 0").select("leg_id", "symbol", "side", "limit_price"), facts)
        both = now.join(near, "symbol", "left").withColumn("__move", F.when(F.col("limit_price") > 0, _move(t, market)))
        move = F.struct(F.lit(v).cast("int").alias("version"), F.col("limit_price").alias("old_price"), F.col("__move.new_price"), F.col("__move.action"))
        both = both.withColumn("moves", F.when(F.col("__move").isNotNull(), F.concat("moves", F.array(move))).otherwise(F.col("moves"))).withColumn("limit_price", F.coalesce("__move.new_price", "limit_price"))
        now = held(both.select(names))
    return now


def rebalance(legs: DataFrame, predictions: DataFrame, versions: Sequence[int], market: str = "US", tuning: RatchetTuning | None = None) -> tuple[DataFrame, DataFrame]:
    """The legs as they stand after the versions in turn, and a row ``version, leg_id, old_price, new_price, action`` for each move.

    ``legs`` are ``leg_id, symbol, side, limit_price``; ``predictions`` ``version, symbol, price, strength, expected_up,
    expected_down``, one a version and symbol. Each version sees the limits that the one before left. A buy stays under
    the price and a sell over it; on a rise limits only rise, on a fall they only fall. Legs without a limit over zero,
    symbols without a price over zero or a prediction, and weak predictions leave everything as it is.
    """
    now = carried(legs, predictions, versions, market, tuning)
    return now.drop("moves"), now.select("leg_id", F.explode("moves").alias("m")).select("leg_id", "m.*")
