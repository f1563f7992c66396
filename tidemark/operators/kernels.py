"""Market kernels: outcomes, trend detectors, clusters, ladders, budgets, portfolio and fills.

Plain column expressions and windows where rows don't depend on earlier decisions; a grouped fold (``applyInPandas``)
for the few that do, always within one key, batch or date.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, float_div, interpolate, logistic, round_to_tick, tick_size
from ..session import held as _held
from .windows import by, first_index, forward, frame, rolling


def outcomes_after(bars: DataFrame, horizons: Sequence[int], label: int) -> DataFrame:
    """Return to the close each number of bars later (infinite or not a number from a close of zero), and WIN, LOSS or FLAT at one of them."""
    out = bars.withColumns({f"t{h}": float_div(F.lead("close", h).over(by()), F.col("close")) - 1 for h in horizons})
    bps = F.col(f"t{label}") * 10_000
    return out.withColumn("label", F.when(bps.isNull(), None).when(bps > 1e-9, "WIN").when(bps < -1e-9, "LOSS").otherwise("FLAT"))


def _side(target: Column, stop: Column, ambiguous: Column, after_cost: Column, band: float) -> Column:
    none = F.lit(99)
    a, b = F.coalesce(target, none), F.coalesce(stop, none)
    return (
        F.when(ambiguous & target.isNotNull() & (a == b), "AMBIGUOUS").when(a < b, "UP_FIRST").when(b < a, "DOWN_FIRST")
        .when(F.abs(after_cost) <= band, "FLAT").when(after_cost > 0, "HORIZON_UP").when(after_cost < 0, "HORIZON_DOWN").otherwise("NO_TRADE")
    )


def event_outcomes(bars: DataFrame, horizon: int = 5, target: float = 0.04, stop: float = 0.03, fee_bps: float = 0.0, slippage_bps: float = 0.0, flat_band: float = 0.005) -> DataFrame:
    """What happened over the bars after each row, to a buyer and to a seller at the next open.

    Rows with no later bar, or no positive entry price, have no outcome. Only bars after the row are read, and the
    outcome is known at the end of its window, so a memory of outcomes can be filtered by date without leaking.
    """
    out = bars.withColumns({"hi": forward("high", horizon), "lo": forward("low", horizon), "cl": forward("close", horizon), "end_day": F.max("day").over(frame(1, horizon)), "entry": F.lead("open").over(by())})
    e = F.col("entry")
    up, down, up_stop, down_stop = e * (1 + target), e * (1 - stop), e * (1 + stop), e * (1 - target)
    out = out.where(e > 0).withColumns({
        "bt": first_index(F.col("hi"), lambda v: v >= up), "bs": first_index(F.col("lo"), lambda v: v <= down), "st": first_index(F.col("lo"), lambda v: v <= down_stop), "ss": first_index(F.col("hi"), lambda v: v >= up_stop),
        "ambiguous": F.exists(F.arrays_zip("hi", "lo"), lambda b: ((b["hi"] >= up) & (b["lo"] <= down)) | ((b["lo"] <= down_stop) & (b["hi"] >= up_stop))),
        "gross": F.element_at("cl", -1) / e - 1, "best": F.greatest(F.lit(0.0), F.array_max("hi") / e - 1), "worst": F.least(F.lit(0.0), F.array_min("lo") / e - 1), "highest": F.array_max("hi") / e - 1, "lowest": F.array_min("lo") / e - 1,
    })
    cost = (fee_bps + slippage_bps) / 10_000
    g, unit = F.col("gross"), lambda x: clip(x, -1, 1)

    def outcome(hit: str, stopped: str, ret: Column, mae: Column, mfe: Column) -> Column:
        net = ret - cost
        return F.struct(
            _side(F.col(hit), F.col(stopped), F.col("ambiguous"), net, flat_band).alias("label"), F.col(hit).cast("int").alias("target_day"), F.col(stopped).cast("int").alias("stop_day"),
            unit(ret).alias("horizon_return"), unit(net).alias("after_cost"), unit(mae).alias("mae"), unit(mfe).alias("mfe"),
        )

    out = out.withColumn("buy", outcome("bt", "bs", g, F.col("worst"), F.col("best")))
    out = out.withColumn("sell", outcome("st", "ss", -g, F.least(F.lit(0.0), -F.col("highest")), F.greatest(F.lit(0.0), -F.col("lowest"))))
    days = F.when(F.col("buy.label").isin("UP_FIRST", "AMBIGUOUS"), F.col("bt")).when(F.col("buy.label") == "DOWN_FIRST", F.col("bs"))
    speed = F.when(days.isNull(), 0.0).otherwise(1 - F.least(days - 1, F.lit(horizon - 1)) / max(horizon - 1, 1))
    excursion = clip(0.6 * F.col("best") + 0.4 * F.greatest(F.lit(0.0), 1 + F.col("worst")), 0, 1)
    quality = clip(0.35 * logistic(8 * (g - cost)) + 0.25 * logistic(6 * g) + 0.20 * excursion + 0.20 * speed, 0, 1)
    path = F.when(F.col("ambiguous"), "AMBIGUOUS").otherwise(F.col("buy.label"))
    return out.withColumns({"path_label": path, "days_to_hit": days.cast("int"), "quality": quality}).drop("hi", "lo", "cl", "bt", "bs", "st", "ss", "best", "worst", "highest", "lowest")


def _noise() -> Column:
    """Mean absolute move over seven bars."""
    return rolling(F.col("move"), 7, F.avg, 7)


def _trend_base(bars: DataFrame, lookback: int, future: int) -> DataFrame:
    past = frame(-lookback, -1)
    out = bars.withColumn("move", F.abs(F.col("close") - F.lag("close").over(by())))
    return out.withColumns({
        "n": F.row_number().over(by()), "rows": F.count("*").over(Window.partitionBy("key")), "atr": _noise(), "slope": (F.lag("close", 1).over(by()) - F.lag("close", lookback).over(by())) / lookback,
        "spread": F.stddev_samp("close").over(past), "past_low": F.min("close").over(past), "past_high": F.max("close").over(past),
        "ahead_high": F.max("close").over(frame(0, future - 1)), "ahead_low": F.min("close").over(frame(0, future - 1)),
    })


def trend_v1(bars: DataFrame, direction: str, lookback: int = 5, future: int = 15, least: float = 0.05, reverse: float = 0.05, flatness: float = 1.0) -> DataFrame:
    """Starts of moves out of a quiet or opposite stretch: enough change ahead, little against it before."""
    b, c = _trend_base(bars, lookback, future), F.col("close")
    up = direction == "UP"
    change = (F.col("ahead_high") - c if up else c - F.col("ahead_low")) / (c + 1e-9)
    against = (c - F.col("past_low") if up else F.col("past_high") - c) / (c + 1e-9)
    quiet = (F.col("slope") <= 0 if up else F.col("slope") >= 0) & (F.col("spread") < F.col("atr") * flatness)
    inside = (F.col("n") > lookback) & (F.col("n") <= F.col("rows") - future) & (c > 1e-9)
    return b.withColumn("change", change).where(inside & quiet & (F.col("change") >= least) & (against <= reverse)).select("key", "day", "close", "change", "slope", "spread", "atr")


_NO_KEY = object()


def trend_v2(bars: DataFrame, direction: str, lookback: int = 5, future: int = 15, least: float = 0.05, reverse: float = 0.05, flatness: float = 1.0) -> DataFrame:
    """Continuations that speed up, top their recent changes and keep a distance; each decision depends on the last."""
    b, c = _trend_base(bars, lookback, future), F.col("close")
    up = direction == "UP"
    change = (F.col("ahead_high") - c if up else c - F.col("ahead_low")) / (c + 1e-12)
    against = F.abs((F.col("ahead_low") - c if up else F.col("ahead_high") - c) / (c + 1e-12))
    quiet = (F.col("slope") <= 0 if up else F.col("slope") >= 0) & (F.col("spread") < (F.col("atr") + 1e-12) * flatness)
    inside = (F.col("n") > lookback) & (F.col("n") <= F.col("rows") - future) & (c > 1e-12)
    rows = b.withColumns({"change": change, "against": against}).where(inside & ~F.coalesce(quiet, F.lit(False))).select("key", "day", "close", "n", "change", "against")
    memory, gap, speed = max(3, min(7, lookback)), max(2, future // 3), least * 0.35

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, recent, before, last = _NO_KEY, deque(maxlen=memory), None, None
        for b in batches:
            taken = []
            for k, n, x, y in zip(*(b.column(c).to_pylist() for c in ("key", "n", "change", "against")), strict=True):
                if k != at:
                    at, recent, before, last = k, deque(maxlen=memory), None, None
                holds = x >= least and y <= reverse
                gain = 0.0 if before is None else x - before
                starts = holds and gain > speed and not (recent and x <= max(recent)) and (last is None or n - last >= gap)
                taken.append(gain if starts else None)
                if starts:
                    last = n
                if holds or before is None:  # a change that doesn't hold is remembered only as the first one
                    before = x
                recent.append(x)
            out = b.select(["key", "day", "close", "change"]).append_column("momentum", pa.array(taken, pa.float64()))
            yield out.filter(out.column("momentum").is_valid())

    kind = dict(bars.dtypes)["key"]
    # a task folds its keys one after the other in one pass
    return rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(run, f"key {kind}, day date, close double, change double, momentum double")


def trend_v3(bars: DataFrame, direction: str, *how) -> DataFrame:
    """Both detectors' signals; the first one's on a shared day."""
    a = trend_v1(bars, direction, *how).select("key", "day", "close", "change", F.lit(1).alias("detector"))
    b = trend_v2(bars, direction, *how).select("key", "day", "close", "change", F.lit(2).alias("detector"))
    first = F.row_number().over(Window.partitionBy("key", "day").orderBy("detector"))
    return a.unionByName(b).withColumn("r", first).where("r = 1").drop("r")


def trend_v4(bars: DataFrame, direction: str, future: int = 15, least: float = 0.05, reverse: float = 0.05) -> DataFrame:
    """Rows whose target is reached within the window and then not given back by more than ``reverse``."""
    up, c = direction == "UP", F.col("close")
    b = bars.withColumn("ahead", forward("close", future)).where((F.size("ahead") == future) & (c > 0))
    at = first_index(F.col("ahead"), (lambda v: v >= c * (1 + least)) if up else (lambda v: v <= c * (1 - least)))
    b = b.withColumn("at", at.cast("int")).where("at IS NOT NULL").withColumn("goal", F.element_at("ahead", F.col("at")))
    rest = F.slice("ahead", F.col("at"), F.lit(future))
    held = F.array_min(rest) >= F.col("goal") * (1 - reverse) if up else F.array_max(rest) <= F.col("goal") * (1 + reverse)
    change = (F.col("goal") - c if up else c - F.col("goal")) / (c + 1e-9)
    return b.where(held).select("key", "day", "close", change.alias("change"))


DETECTORS = {"v1": trend_v1, "v2": trend_v2, "v3": trend_v3, "v4": trend_v4}


def additive_drawdown(returns: DataFrame) -> DataFrame:
    """Largest fall of the running sum of ``ret`` from its peak, which starts at zero."""
    run = by().rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("equity", F.sum("ret").over(run))
    out = out.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(run)))
    return out.groupBy("key").agg(F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"))


def latest_price_and_range(bars: DataFrame, rows: int = 14, least_rows: int = 5, default: float = 0.05) -> DataFrame:
    """Last close, and the mean range of the last rows as a share of the close, from 0.01 to 0.2."""
    last = bars.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("day")))).where(F.col("n") <= rows)
    mean = F.avg(F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close")))
    return last.groupBy("key").agg(F.max(F.when(F.col("n") == 1, F.col("close"))).alias("price"), F.when(F.count("*") < least_rows, default).otherwise(clip(mean, 0.01, 0.2)).alias("atr_pct"))


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    n = np.linalg.norm(x, axis=1)
    return np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0)


#: Rows whose leaders are found in one round: of all dates, and of one.
ROUND_ROWS, BLOCK_ROWS = 40_000, 4_096


def _first_ids(rows: DataFrame, block: int) -> DataFrame:
    """The last of each date's first ``block`` rows; a task gives its own first ones, so only these are shuffled."""
    ids = rows.select("as_of", "row_id")

    def first(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by([("as_of", "ascending"), ("row_id", "ascending")])
        dates = t["as_of"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(dates, prepend=-1))
        place = np.arange(len(dates)) - np.repeat(starts, np.diff(np.append(starts, len(dates))))
        return t.filter(pa.array(place < block)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            n += b.num_rows
            if n > 4 * ROUND_ROWS:
                kept, n = first(kept), 0
        if kept:
            yield from first(kept)

    order = Window.partitionBy("as_of").orderBy("row_id")
    head = ids.mapInArrow(run, ids.schema).withColumn("n", F.row_number().over(order)).where(F.col("n") <= block)
    return head.groupBy("as_of").agg(F.max("row_id").alias("last"))


def leader_clusters(rows: DataFrame, least: float = 0.985, keep: bool = True) -> DataFrame:
    """For each ``as_of``, rows in order of ``row_id`` (unique there) join the first cluster whose first member is similar enough.

    In rounds: a bounded block of each date's first rows is folded, its leaders are sent to all tasks, and what follows
    joins one of them or waits for the next round. A later leader never comes before these, so the order is kept. Only
    the blocks are shuffled. Without ``keep`` the rows are made again in the first round's passes and not written first;
    they must come out the same each time.
    """
    kinds = dict(rows.dtypes)
    ids = f"as_of {kinds['as_of']}, row_id {kinds['row_id']}"
    left = rows.select("as_of", "row_id", "vector")
    left = _held(left) if keep else left
    dates = left.select("as_of").distinct().count()
    block = max(1, min(BLOCK_ROWS, ROUND_ROWS // max(1, dates)))

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("row_id")
        x, base = _units(df["vector"]), int(df["base"].iloc[0])
        leaders, n, home, near = np.zeros_like(x), 0, [], []
        for v in x:
            s = leaders[:n] @ v
            hit = np.flatnonzero(s >= least)
            if len(hit):
                home.append(hit[0])
                near.append(s[hit[0]])
            else:
                home.append(n)
                near.append(1.0)
                leaders[n] = v
                n += 1
        home = np.array(home)
        new = np.diff(np.maximum.accumulate(home), prepend=-1) > 0
        return pd.DataFrame({"as_of": df["as_of"].to_numpy(), "row_id": df["row_id"].to_numpy(), "cluster": (home + base).astype(np.int32), "similarity": near, "leader": [list(v) if f else None for v, f in zip(x, new, strict=True)]})

    def assign(shared):
        def run(frames):
            for df in frames:
                if df.empty:
                    continue
                home, near, after = np.full(len(df), -1, np.int32), np.zeros(len(df)), np.ones(len(df), bool)
                for key, at in df.groupby("as_of").indices.items():
                    cluster, leaders, last = shared.value[key]
                    after[at] = df["row_id"].to_numpy()[at] > last
                    for lo in range(0, len(at), 1_000):
                        p = at[lo : lo + 1_000]
                        s = _units(df["vector"].iloc[p]) @ leaders.T
                        hit = s >= least
                        j = hit.argmax(axis=1)
                        home[p] = np.where(hit.any(axis=1), cluster[j], -1) if len(cluster) else -1
                        near[p] = s[np.arange(len(p)), j]
                yield df.assign(vector=df["vector"].where(home < 0, None), cluster=home, similarity=near)[after]

        return run

    out, base = [], None
    while not left.isEmpty():
        last = {r.as_of: r.last for r in _first_ids(left, block).collect()}  # a row a date
        cut = left.sparkSession.createDataFrame([*last.items()], f"__as_of {kinds['as_of']}, __last {kinds['row_id']}")
        head = left.join(F.broadcast(cut), left["as_of"].eqNullSafe(cut["__as_of"]) & (left["row_id"] <= cut["__last"])).select("as_of", "row_id", "vector")
        head = head.withColumn("base", F.lit(0)) if base is None else head.join(F.broadcast(base), "as_of")  # a row a date
        found = _held(head.groupBy("as_of").applyInPandas(fold, f"{ids}, cluster int, similarity double, leader array<double>"))
        out.append(found.drop("leader"))
        grown = found.groupBy("as_of").agg((F.max("cluster") + 1).alias("base"))
        base = grown if base is None else grown.unionByName(base).groupBy("as_of").agg(F.max("base").alias("base"))
        heads: dict = {k: ([], []) for k in last}
        for r in found.where("leader IS NOT NULL").orderBy("as_of", "cluster").toLocalIterator():  # ROUND_ROWS at most, or one a date
            heads[r.as_of][0].append(r.cluster)
            heads[r.as_of][1].append(r.leader)
        shared = left.sparkSession.sparkContext.broadcast({k: (np.array(c, np.int32), np.array(v, float), last[k]) for k, (c, v) in heads.items()})
        rest = _held(left.mapInPandas(assign(shared), f"{ids}, vector {kinds['vector']}, cluster int, similarity double"))
        out.append(rest.where("cluster >= 0").drop("vector"))
        left = rest.where("cluster < 0").drop("cluster", "similarity")
    if not out:
        return left.select("as_of", "row_id", F.lit(0).alias("cluster"), F.lit(1.0).alias("similarity"))
    return reduce(DataFrame.unionByName, out)


@dataclass(frozen=True)
class LadderTuning:
    """Distances are shares of the price. ``floor`` binds eager orders; None is 1 % in Korea and nothing elsewhere."""

    base_legs: float = 3
    leg_boost: float = 1.0
    base: float = 0.010
    least: float = 0.005
    most: float = 0.060
    gain_scale: float = 0.10
    gain_weight: float = 0.6
    atr_hint: float = 0.0
    atr_weight: float = 0.5
    floor: float | None = None
    spread: float = 0.0
    tick_gap: int = 1
    gap: float = 0.03
    max_step: float = 0.060
    decay: float = 1.25


def first_leg(s: Column, price: Column, market: str, side: str, tuning: LadderTuning, gain: Column, label: Column, adverse: Column, wanted: Column) -> Column:
    """Distance of the first leg from the price, on a whole tick.

    It falls with the signal's strength, leans on the gain so far, and gives way to what the target's label says about
    the first days (``adverse``: their mean excursion) and to a standing recommendation (``wanted``).
    """
    # fixed values: the coefficients of pull, eagerness and adverse moves
    t, sell = tuning, side == "SELL"
    sign, step = (1 if sell else -1), tick_size(price, market) / price
    pull = 0.8 + (s + 1) * 0.8 if sell else 2.4 - (s + 1) * 0.8
    pct = t.base * pull * (1 + t.gain_weight * clip(sign * gain / t.gain_scale, -1, 1))
    pct = F.least(F.greatest(pct, F.lit(t.atr_hint * t.atr_weight), F.lit(t.least)), F.lit(t.most))
    eager = s < -0.7 if sell else s > 0.7
    pct = F.when(eager, pct * (1.7 - F.abs(s))).otherwise(pct)
    if sell:
        pct = F.when((label == "UP_FIRST") & (adverse > 0.01), pct * 0.85).otherwise(pct)
    else:
        pct = F.when((label == "DOWN_FIRST") & (adverse < -0.01), pct * (1 + F.least(F.abs(adverse) * 0.5, F.lit(0.08)))).otherwise(pct)
    floor = (0.010 if market == "KR" else 0.0) if t.floor is None else t.floor
    if floor > 0:
        pct = F.when(eager, F.greatest(pct, F.lit(floor))).otherwise(pct)
    if not sell:
        pct = F.when(wanted, F.greatest(pct * 0.85, F.lit(t.least))).otherwise(pct)
    pct = F.greatest(F.bround(pct / step) * step, step)
    test = round_to_tick(price * (1 + sign * pct), market, side)
    stuck = test <= price if sell else test >= price
    test = F.when(stuck, round_to_tick(price * (1 + sign * (pct + 1e-4)), market, side)).otherwise(test)
    return clip(F.abs(test / price - 1), t.least, t.most)


def ladder(orders: DataFrame, market: str = "US", side: str = "BUY", tuning: LadderTuning | None = None) -> DataFrame:
    """Limit legs of orders (``id``, ``price``, ``strength``, ``quantity``): two to six geometric steps away from the price.

    Columns ``gain``, ``label``, ``adverse`` and ``wanted`` are hints, if there. Quantities fall off exponentially and
    are apportioned by largest remainder (ties to the nearer leg); legs on one tick merge; the farthest leg moves out
    until it is the gap from the first. Orders without quantity or price have no legs.
    """
    t = tuning or LadderTuning()
    gap, decay = t.gap, t.decay
    sell, sign = side == "SELL", 1 if side == "SELL" else -1
    s = F.col("strength") if sell else F.abs("strength")
    none = {"gain": F.lit(0.0), "label": F.lit(None).cast("string"), "adverse": F.lit(None).cast("double"), "wanted": F.lit(False)}
    o = orders.withColumns({c: v for c, v in none.items() if c not in orders.columns}).where("quantity >= 1 AND price > 0").withColumn("s", s.cast("double"))
    most = F.floor(clip(t.base_legs + F.abs("s") * t.leg_boost, 2, 6)).cast("int")
    legs = F.when(F.col("quantity") == 2, 2).otherwise(F.greatest(F.lit(1), F.least(most, F.col("quantity")))).cast("int")
    first = first_leg(F.col("s"), F.col("price"), market, side, t, F.col("gain"), F.col("label"), F.col("adverse"), F.coalesce("wanted", F.lit(False)))
    o = o.withColumns({"legs": legs, "first": first, "tick": tick_size(F.col("price"), market)})
    eager = F.col("s") < -0.7 if sell else F.col("s") > 0.7
    size = F.abs("s")
    widen = F.when(eager, 1.2 + 0.8 * size).otherwise(1.5 + 1.5 * size)
    spread = F.greatest(F.lit(t.spread), F.greatest(F.lit(1), F.col("legs") - 1) * t.tick_gap * F.col("tick") / F.col("price"))
    # the step limit gives way to the gap
    last = F.greatest(F.col("first") * widen, F.col("first") + spread, F.col("first") + gap)
    o = o.withColumn("ratio", F.when(F.col("legs") > 1, F.pow(last / F.col("first"), 1 / (F.col("legs") - 1))).otherwise(F.lit(1.0)))
    steps = F.greatest(F.lit(1), F.col("legs") - 1)
    weights = F.transform(F.sequence(F.lit(0), F.col("legs") - 1), lambda i: F.exp(-decay * i / steps))
    o = o.withColumn("weights", weights).withColumn("extra", F.col("quantity") - F.col("legs"))
    total = F.aggregate("weights", F.lit(0.0), lambda a, v: a + v)
    # a row an order throughout: its six legs at most are arrays, so nothing is shuffled or sorted
    o = o.withColumn("total", total).withColumn("share", F.transform("weights", lambda w: F.col("extra") * w / F.col("total")))
    o = o.withColumns({"rest": F.transform("share", lambda x: x - F.floor(x)), "left": F.col("extra") - F.aggregate("share", F.lit(0).cast("long"), lambda a, x: a + F.floor(x))})
    before = lambda r, i: F.size(F.filter("rest", lambda x, j: (x > r) | ((x == r) & (j < i))))
    more = F.transform("rest", lambda r, i: F.when(before(r, i) < F.col("left"), 1).otherwise(0))
    at = F.transform(F.sequence(F.lit(0), F.col("legs") - 1), lambda i: round_to_tick(F.col("price") * (1 + sign * F.col("first") * F.pow("ratio", i)), market, side))
    o = o.select("id", "price", "legs", "tick", at.alias("at"), F.zip_with("share", more, lambda x, m: 1 + F.floor(x) + m).alias("qty"))
    there = lambda p: F.aggregate(F.zip_with("at", "qty", lambda a, q: F.when(a.eqNullSafe(p), q).otherwise(0)), F.lit(0).cast("long"), lambda a, q: a + q)
    # the gap between first and farthest leg, and where the farthest has to go
    near, far = (F.array_min, F.array_max) if sell else (F.array_max, F.array_min)
    held = o.select("id", "price", "legs", "tick", near("at").alias("near"), far("at").alias("far"), F.transform(F.array_distinct("at"), lambda p: F.struct(p.alias("limit_price"), there(p).alias("qty"))).alias("all"))
    short = (F.col("legs") >= 2) & (F.abs(F.col("far") - F.col("near")) / F.col("price") + 1e-12 < F.greatest(gap - F.col("tick") / F.col("price") * 0.5, F.lit(0.0)))
    goal = round_to_tick(F.col("price") * (1 + sign * (F.abs(F.col("near") / F.col("price") - 1) + gap)), market, side)
    tries = F.transform(F.sequence(F.lit(0), F.lit(50)), lambda k: F.round(goal + sign * k * F.col("tick"), 6))
    beyond = (lambda p: p > F.col("far")) if sell else (lambda p: p < F.col("far"))
    clear = lambda p: beyond(p) & ~F.exists("all", lambda q: (q["limit_price"] != F.col("far")) & (F.abs(p - q["limit_price"]) < F.col("tick") * t.tick_gap))
    moved = F.coalesce(F.get(F.filter(tries, clear), F.lit(0)), F.element_at(tries, -1))
    fixed = F.transform("all", lambda q: F.struct(F.when(short & (q["limit_price"] == F.col("far")), moved).otherwise(q["limit_price"]).alias("limit_price"), q["qty"].alias("qty")))
    nearer = F.array_sort(fixed) if sell else F.reverse(F.array_sort(fixed))
    out = held.select("id", F.posexplode(nearer).alias("place", "leg")).select("id", (F.col("place") + 1).alias("place"), "leg.*")
    return out.select("id", F.lit(side).alias("side"), F.col("place").alias("leg"), F.round("limit_price", 6).alias("limit_price"), F.col("qty").cast("long").alias("quantity"))


def allocate(c: DataFrame, cash: float, soft: float = 2.0, weight: float = 0.25, legs: int = 2, beta: float = 1.0, alpha: float = 1.0, penalty: float = 0.5, market: str = "US") -> DataFrame:
    """Budgets of each ``batch``'s candidates (``id, price, atr_pct, signal``): what the least ladder costs, then the rest by priority.

    The dearest candidates go until the least ladders fit; both passes then run in order of priority, and what one
    candidate takes in the second is gone for the next, so each batch passes through one task in that order. The first
    pass takes all that is kept, as their least needs fit together.
    """
    size = F.count("*").over(Window.partitionBy("batch"))
    cap = F.least(soft * cash / size, F.lit(weight * cash))
    limit = round_to_tick(F.col("price") * (1 - F.greatest(F.lit(0.012), 0.4 * F.col("atr_pct"))), market, "")
    c = c.withColumn("cap", cap).where("price > 0 AND signal > 0").withColumn("required", legs * limit)
    risk = F.greatest(F.col("price") * F.col("atr_pct"), F.lit(1e-9))
    fit = F.least(F.lit(1.0), F.col("cap") / F.greatest(F.col("required"), F.lit(1e-9)))
    c = c.withColumn("priority", F.pow("signal", F.lit(beta)) / F.pow(risk, F.lit(alpha)) * F.pow(fit, F.lit(penalty))).withColumn("need", F.least("required", "cap"))
    # keep the cheapest as long as their least needs fit together; a sum that is the cash but for rounding fits. Sums of
    # doubles drift with the number of candidates, so needs are added up as decimals
    needs = F.sum(F.col("need").cast("decimal(38,18)"))
    running = needs.over(Window.partitionBy("batch").orderBy("price", "id").rowsBetween(Window.unboundedPreceding, 0))
    kept = c.withColumn("running", running.cast("double")).where(F.col("running") <= cash * (1 + 1e-12))
    kinds = dict(c.dtypes)

    kept = kept.where("need > 0").withColumn("total", F.sum("priority").over(Window.partitionBy("batch")))
    kept = kept.withColumn("rest", cash - needs.over(Window.partitionBy("batch")).cast("double"))

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, rest = object(), 0.0
        for df in frames:
            budget = df["need"].to_numpy(float).copy()
            for i, r in enumerate(df.itertuples(index=False)):
                own = None if pd.isna(r.batch) else r.batch
                if own != batch:
                    batch, rest = own, r.rest
                more = min(r.cap - r.need, rest * r.priority / (r.total or 1.0))
                if more > 0:
                    budget[i], rest = budget[i] + more, rest - more
            yield df.assign(budget=budget)[["batch", "id", "budget"]]

    # sorted rows pass by, so a task holds what is left of one batch's cash and not its rows
    ordered = kept.select("batch", "id", "price", "cap", "need", "priority", "total", "rest").repartition("batch").sortWithinPartitions("batch", F.desc("priority"), "price", "id")
    return ordered.mapInPandas(second, f"batch {kinds['batch']}, id {kinds['id']}, budget double")


def select_portfolio(
    c: DataFrame, capital: float, top: int = 5, per_sector: int = 2, per_group: int = 1, turnover: int = 5, risk: float = 0.95, least_ev: float = 0.0, cash: float | None = None, reserved: float = 0.0
) -> DataFrame:
    """Decisions on each day's candidates in order of utility; a refused one keeps the first reason that holds.

    Ids are unique on a day; ``overlap``, if there, lowers the utility. Limits only ever fill up, so of a side and sector
    no more than its first ``per_group`` candidates that nothing of their own speaks against can be taken: these few pass by
    in order, and the reasons of all follow from running counts of what was taken before.
    """
    # fixed values: weights of the utility
    utility = F.col("policy_utility") + 0.35 * F.col("ev") + 0.10 * F.col("confidence") - 0.50 * F.col("uncertainty")
    if "overlap" in c.columns:
        utility = utility - 0.25 * F.coalesce("overlap", F.lit(0.0))
    capital = capital if cash is None else max(0.0, min(capital, cash - reserved))
    share = capital * risk / top
    size = clip(F.when(F.col("no_trade"), 0.0).otherwise(F.col("size")), 0, 2)
    c = c.withColumn("utility", utility).withColumns({"group": F.concat_ws(":", "side", "sector"), "wish": share * size * clip(1 + F.col("utility"), 0.25, 1.5)})
    order = [F.desc("utility"), F.desc("ev"), F.desc("confidence"), F.col("id")]
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(*order)))
    own = F.when(F.col("held"), "already_open").when(F.col("no_trade"), "quote_policy_no_trade").when(F.col("ev") < least_ev, "below_ev_threshold")
    c = c.withColumn("own", own)
    first = F.row_number().over(Window.partitionBy("day", "group").orderBy("place"))
    few = c.where("own IS NULL AND wish > 0").withColumn("n", first).where(F.col("n") <= per_group).select("day", "place", "sector", "wish")

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, names, left, sectors = None, 0, capital, Counter()
        for df in frames:
            out = []
            for r in df.itertuples(index=False):
                if r.day != day:
                    day, names, left, sectors = r.day, 0, capital, Counter()
                if sectors[r.sector] < per_sector and names < min(turnover, top) and left > 0:
                    budget = min(r.wish, left)
                    out.append((r.day, r.place, budget))
                    sectors[r.sector] += 1
                    names, left = names + 1, left - budget
            yield pd.DataFrame(out, columns=["day", "place", "taken"])

    # sorted rows pass by, so a task holds what one day has left and not its rows
    taken = few.repartition("day").sortWithinPartitions("day", "place").mapInPandas(take, "day date, place int, taken double")
    both = c.join(taken, ["day", "place"], "left").withColumns({"one": F.col("taken").isNotNull().cast("int"), "budget": F.coalesce("taken", F.lit(0.0))})
    before = lambda x, *keys: F.coalesce(F.sum(x).over(Window.partitionBy("day", *keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.least(F.col("wish"), F.greatest(F.lit(0.0), capital - before("budget")))
    why = (
        F.when(F.col("own").isNotNull(), F.col("own")).when(before("one", "sector") >= per_sector, "sector_cap").when(before("one", "group") >= per_group, "correlated_cap")
        .when(before("one") >= turnover, "turnover_budget").when(before("one") >= top, "top_n_limit").when(room <= 0, "capital_reserved")
    )
    return both.select("day", "id", (F.col("one") == 1).alias("selected"), why.alias("reason"), "budget")


def simulate_fills(legs: DataFrame, bars: DataFrame, days: int = 30, part: float = 0.5, slippage_bps: float = 0.0, cap: bool = True) -> DataFrame:
    """Fills of limit legs (``key, day, leg_id, side, limit_price, quantity``) by bars after their day, up to ``days`` later.

    A bar that touches the limit fills ``part`` of the quantity (one at least), at its open if the limit is at or over
    it, else at the limit. ``cap`` keeps the sum to the quantity; without it every touching bar fills again, as the
    older rule did. A leg that no bar touches has one row without a fill. Fills stand on their own day.
    """
    b = bars.select("key", F.col("day").alias("bar_day"), "open", "high", "low")
    after = (F.col("bar_day") > F.col("day")) & (F.col("bar_day") <= F.date_add("day", days))
    touch = legs.join(b, "key").where(after & F.col("limit_price").between(F.col("low"), F.col("high")))
    n = F.row_number().over(Window.partitionBy("leg_id").orderBy("bar_day"))
    step = F.when(F.col("quantity") > 1, F.greatest(F.lit(1), F.floor(F.col("quantity") * part))).otherwise(F.col("quantity")).cast("long")
    touch = touch.withColumn("n", n).withColumn("step", step)
    room = F.col("quantity") - (F.col("n") - 1) * F.col("step")
    filled = F.least("step", room) if cap else F.when((F.col("n") == 1) | (F.col("step") < F.col("quantity")), F.col("step")).otherwise(0)
    price = F.when(F.col("limit_price") >= F.col("open"), F.col("open")).otherwise(F.col("limit_price"))
    price = price * F.when(F.col("side") == "BUY", 1 + slippage_bps / 10_000).otherwise(1 - slippage_bps / 10_000)
    done = touch.withColumns({"filled": filled.cast("long"), "fill_price": price}).where("filled > 0")
    done = done.withColumn("status", F.when(F.col("filled") == F.col("quantity"), "FULL").otherwise("PARTIAL"))
    columns = ["key", "day", "leg_id", "bar_day", "filled", "fill_price", "status"]
    missed = legs.join(done.select("leg_id").distinct(), "leg_id", "left_anti").select("key", "day", "leg_id", F.lit(None).cast("date").alias("bar_day"), F.lit(0).cast("long").alias("filled"), F.lit(None).cast("double").alias("fill_price"), F.lit("UNFILLED").alias("status"))
    return done.select(columns).unionByName(missed)


def risk_multipliers(discount: Column, legs: DataFrame, market: str = "US", side: str = "BUY") -> DataFrame:
    """Legs (``id, limit_price, quantity``) with prices moved by a multiplier of at most 0.95 (buys) or 1.8 (sells), on ticks."""
    m = F.least(discount, F.lit(0.95 if side == "BUY" else 1.8))
    return legs.withColumn("limit_price", round_to_tick(F.col("limit_price") * m, market, side))


def stop_band(gain: Column, soft: float, hard: float, timed_out: Column) -> Column:
    """Share of a position to sell: half past the hard stop, three tenths past the soft one once time is up."""
    return F.when(gain <= -hard, 0.5).when((gain <= -soft) & timed_out, 0.3).otherwise(0.0)


def strength_to_share(strength: Column, least: float) -> Column:
    return interpolate(F.abs(strength), least, 1.0, 0.20, 0.60)
