"""The research layer: features, event memory, prototypes, distributions and decisions, without a look ahead."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions.scalars import clip, dead_zone_sign, float_div, guarded_div
from ..session import held
from .kernels import leader_clusters
from .relational import asof
from .windows import by, change, deviation, frame, percentile_of_last, rolling, true_range

HORIZONS = (1, 3, 5, 10, 20, 60)


def bar_features(bars: DataFrame, horizons: Sequence[int] = HORIZONS, guard: bool = True) -> DataFrame:
    """Shape and liquidity features of every bar from it and the bars before it; 0 where there are too few.

    With ``guard`` a quotient by zero is 0, so that one price of zero does not spoil every vector scaled with it;
    without, it is what floating-point division gives.
    """
    over = guarded_div if guard else float_div
    out = bars.withColumns({f"ret_{h}": F.coalesce(change(h, guard), F.lit(0.0)) for h in horizons} | {"move": change(1, guard), "range": F.coalesce(true_range(), F.col("high") - F.col("low")), "before": F.coalesce(F.lag("close").over(by()), F.col("open")), "dollars": F.col("close") * F.col("volume")})
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-8))
    earlier = by().rowsBetween(Window.unboundedPreceding, -1)
    seen = F.collect_list("dollars").over(earlier)
    first = F.count("*").over(earlier) == 0
    rank = F.when(first, 1.0).otherwise(F.size(F.filter(seen, lambda v: v <= F.col("dollars"))) / F.size(seen))
    return out.withColumns({
        "realized_vol_20": F.coalesce(deviation(F.col("move"), 20), F.lit(0.0)), "atr_pct_14": over(rolling(F.col("range"), 14, F.avg), F.col("close")), "drawdown_20": V.worst_fall(F.collect_list("close").over(frame(-19))),
        "gap_pct": over(F.col("open") - F.col("before"), F.col("before")), "close_location": (F.col("close") - F.col("low")) / span, "body_pct": F.abs(F.col("close") - F.col("open")) / span,
        "upper_wick_pct": (F.col("high") - F.greatest("open", "close")) / span, "lower_wick_pct": (F.least("open", "close") - F.col("low")) / span,
        "relative_volume": guarded_div(F.col("volume"), F.coalesce(F.avg("volume").over(earlier), F.col("volume"))), "dollar_volume_percentile": rank, "log_dollar_volume": F.log10(F.greatest(F.col("dollars"), F.lit(1.0))),
    }).drop("move", "range", "before", "dollars")


def residual_features(features: DataFrame, index: DataFrame, horizons: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """Own returns less those of an index, by date."""
    whole = Window.orderBy("day")  # one row a day
    market = index.select("day", *(F.coalesce(F.col("close") / F.lag("close", h).over(whole) - 1, F.lit(0.0)).alias(f"mkt_{h}") for h in horizons))
    out = features.join(F.broadcast(market), "day", "left")  # as many rows as days
    return out.withColumns({f"mkt_rel_ret_{h}": F.col(f"ret_{h}") - F.coalesce(f"mkt_{h}", F.lit(0.0)) for h in horizons}).drop(*(f"mkt_{h}" for h in horizons))


def context_features(series: DataFrame) -> DataFrame:
    """Seven features of each observation of a macro series (``key, day, value``) from it and those before."""
    seen = lambda n: F.collect_list("value").over(frame(1 - n))
    x = F.col("value")
    back = lambda h: F.lag("value", h).over(by())
    window = seen(20)
    five = seen(5)
    return series.withColumns({
        "zscore_20": F.when(V.std(window) > 1e-12, (x - V.mean(window)) / V.std(window)).otherwise(0.0),
        **{f"change_{h}": F.coalesce(x - back(h), F.lit(0.0)) for h in (5, 20)}, **{f"pct_change_{h}": F.coalesce(guarded_div(x - back(h), back(h)), F.lit(0.0)) for h in (5, 20)},
        "percentile_20": percentile_of_last(window), "slope_5": F.when(F.size(five) > 1, guarded_div(F.element_at(five, -1) - F.element_at(five, 1), F.size(five) - 1.0)).otherwise(0.0),
    })


#: Ranges of time into which few series are cut when they are joined with all anchors.
PIECES = 64


def order_violations(anchors: DataFrame, observed: DataFrame, names: Sequence[str]) -> DataFrame:
    """``name, key, anchor, observed, published, cause``: what each anchor would be joined with by time of observation, and what is wrong with it.

    ``anchors`` are ``key, anchor``; ``observed`` are ``name, observed, published``. NO_SOURCE: nothing observed by then;
    UNDATED: it has no time of publication; LOOK_AHEAD: it was published after the anchor; else null. All pairs come
    from one sorted pass in ranges of time, so neither a long series nor a hot key is a single task.
    """
    named = anchors.crossJoin(F.broadcast(anchors.sparkSession.createDataFrame([(n,) for n in names], "name string")))  # a few names
    out = asof(named, observed, ["name"], "anchor", "observed", ["observed", "published"], ["published"], pieces=PIECES).withColumnsRenamed({"asof_observed": "observed", "asof_published": "published"})
    cause = F.when(F.col("observed").isNull(), "NO_SOURCE").when(F.col("published").isNull(), "UNDATED").when(F.col("published") > F.col("anchor"), "LOOK_AHEAD")
    return out.withColumn("cause", cause)


def violation_report(pairs: DataFrame) -> DataFrame:
    """``name, cause, rows, share, keys, worst_hours`` of :func:`order_violations`; pairs in order have the cause OK. Shares are of the name's pairs."""
    lead = (F.col("published").cast("timestamp").cast("double") - F.col("anchor").cast("timestamp").cast("double")) / 3_600
    by = pairs.groupBy("name", F.coalesce("cause", F.lit("OK")).alias("cause")).agg(F.count("*").alias("rows"), F.count_distinct("key").alias("keys"), F.max(F.when(F.col("cause") == "LOOK_AHEAD", lead)).alias("worst_hours"))
    total = F.sum("rows").over(Window.partitionBy("name"))  # a few causes
    return by.withColumn("share", F.col("rows") / total)


def freshness(anchors: DataFrame, macro: DataFrame, bar_times: DataFrame, names: Sequence[str]) -> DataFrame:
    """How old each macro series is at each anchor (``key, anchor``): days, bars, stale flag and age bucket.

    The newest value published by the anchor is found by an as-of join; bars since then are a difference of two running
    counts, so there is no range join. A series with nothing published is 999 days and bars old, stale, bucket 3.
    """
    counted = bar_times.withColumn("bars", F.row_number().over(Window.partitionBy("key").orderBy("at"))).select("key", "at", "bars")
    out = asof(anchors.crossJoin(F.broadcast(anchors.sparkSession.createDataFrame([(n,) for n in names], "name string"))), macro, ["name"], "anchor", "published", ["published", "value"], pieces=PIECES)  # a few names
    out = asof(out.withColumnRenamed("asof_published", "source_at").withColumnRenamed("asof_value", "level"), counted, ["key"], "anchor", "at", ["bars"]).withColumnRenamed("asof_bars", "now")
    known = out.where("source_at IS NOT NULL")
    then = asof(known, counted, ["key"], "source_at", "at", ["bars"]).withColumnRenamed("asof_bars", "then")
    gone = out.where("source_at IS NULL").withColumn("then", F.lit(None).cast("int"))
    both = then.unionByName(gone)
    missing = F.col("source_at").isNull()
    days = F.when(missing, 999.0).otherwise((F.col("anchor").cast("timestamp").cast("double") - F.col("source_at").cast("timestamp").cast("double")) / 86_400)
    bars = F.when(missing, 999).otherwise(F.coalesce("now", F.lit(0)) - F.coalesce("then", F.lit(0)))
    both = both.withColumns({"days_since_update": days, "bars_since_update": bars.cast("double")})
    stale = (F.col("days_since_update") > 3) | (F.col("bars_since_update") > 3)
    bucket = F.when(missing, 3).when(stale, F.when(F.col("days_since_update") <= 7, 2).otherwise(3)).when(F.col("days_since_update") > 1, 1).otherwise(0)
    return both.withColumns({"is_stale": stale.cast("int"), "age_bucket": bucket}).drop("now", "then")


def regime(context: DataFrame, edge: float = 0.2) -> DataFrame:
    """Risk state of each day: the mean sign, over series, of the first feature that says anything."""
    say = lambda c: F.when(F.abs(c) > 1e-12, c)
    score = F.coalesce(say(F.col("zscore_20")), say(F.col("pct_change_20")), say(F.col("pct_change_5")), say(F.col("slope_5")), F.col("percentile_20") - 0.5)
    out = context.groupBy("day").agg(F.avg(dead_zone_sign(score)).alias("score"))
    return out.withColumn("regime", F.when(F.col("score") > edge, "RISK_ON").when(F.col("score") < -edge, "RISK_OFF").otherwise("NEUTRAL"))


def memory_asof(events: DataFrame, dates: DataFrame) -> DataFrame:
    """Each decision date (``as_of``) with the events whose outcome ended before it."""
    return dates.join(events, F.col("end_day") < F.col("as_of"))


def memory_scalers(events: DataFrame, dates: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and deviation of every feature over each date's memory, and its last end date, from sums by end date run forward: one row a date."""
    sums = [f(F.coalesce(F.col(c), F.lit(0.0))).alias(f"{n}_{c}") for c in features for n, f in (("s", F.sum), ("q", lambda x: F.sum(x * x)))]
    daily = events.groupBy("end_day").agg(F.count("*").alias("n"), *sums)
    rows = daily.withColumn("as_of", F.lit(None).cast("date")).unionByName(dates.select("as_of", F.col("as_of").alias("end_day")), allowMissingColumns=True)
    before = Window.orderBy("end_day").rangeBetween(Window.unboundedPreceding, -1)  # a row a day
    run = lambda c: F.sum(c).over(before)
    rows = rows.withColumn("end_day", F.datediff("end_day", F.lit("1970-01-01").cast("date")))
    last = F.date_add(F.lit("1970-01-01").cast("date"), F.max(F.when(F.col("as_of").isNull(), F.col("end_day"))).over(before))
    out = rows.select("as_of", run("n").alias("n"), last.alias("last_end"), *(run(f"{k}_{c}").alias(f"{k}_{c}") for c in features for k in "sq")).where("as_of IS NOT NULL AND n > 0")
    for c in features:
        mean = F.col(f"s_{c}") / F.col("n")
        out = out.withColumns({f"mean_{c}": mean, f"std_{c}": F.when(F.col("n") == 1, 1.0).otherwise(F.greatest(F.lit(1e-8), F.sqrt(F.greatest(F.col(f"q_{c}") / F.col("n") - mean * mean, F.lit(0.0)))))}).drop(f"s_{c}", f"q_{c}")
    return out


def embed(rows: DataFrame, scalers: DataFrame, features: Sequence[str]) -> DataFrame:
    """Standardised features in sorted order as ``vector``; the scalers are joined by ``as_of``."""
    out = rows.join(scalers, "as_of")
    z = [F.when(F.col(f"std_{c}") <= 1e-12, 0.0).otherwise((F.coalesce(c, F.lit(0.0)) - F.col(f"mean_{c}")) / F.col(f"std_{c}")) for c in sorted(features)]
    return out.withColumn("vector", F.array(*z)).drop("n", "last_end", *(f"{k}_{c}" for c in features for k in ("mean", "std")))


def prototypes(memory: DataFrame, least: float = 0.985, half_life: float = 90.0, min_support: int = 1, min_decayed: float = 0.0, facts: DataFrame | None = None) -> DataFrame:
    """Clusters of each date's memory with statistics of both sides.

    ``memory`` has ``as_of, row_id, day, vector, quality, liquidity, regime, sector, buy, sell``; the best member by
    quality, then liquidity, then order represents the cluster. Where ``facts`` has all but ``as_of`` and ``vector``, one
    row a ``row_id``, memory needs only ``as_of, row_id, vector``, is made again in each pass and must come out the same:
    then it is neither written nor shuffled, and clusters meet the facts by ``row_id``.
    """
    found = leader_clusters(memory.select("as_of", "row_id", "vector"), least, keep=facts is None).drop("similarity")
    m = memory.join(found, ["as_of", "row_id"]) if facts is None else found.join(facts, "row_id")
    best = F.struct("quality", "liquidity", (-F.col("row_id")).alias("o"))
    keys = ["as_of", "cluster"]
    aggs = [F.count("*").alias("support"), F.avg("quality").alias("quality"), F.avg("liquidity").alias("liquidity"), F.max("day").alias("last_day"), F.sum(F.pow(F.lit(0.5), F.greatest(F.datediff("as_of", "day"), F.lit(0)) / half_life)).alias("decayed"),
            *(F.max_by(c, best).alias(c) for c in ("vector" if facts is None else "row_id", "regime", "sector"))]
    for s in ("buy", "sell"):
        r = F.col(f"{s}.after_cost")
        q = F.percentile(r, F.array(*map(F.lit, (0.1, 0.5, 0.9))))  # one gathering of values for all of them
        hit = lambda v, s=s: F.count_if(F.col(f"{s}.label") == v)
        total = F.greatest(hit("UP_FIRST") + hit("DOWN_FIRST") + hit("FLAT") + hit("AMBIGUOUS") + hit("NO_TRADE"), F.count("*"))
        aggs.append(F.struct(
            F.avg(r).alias("mean"), q[1].alias("median"), F.coalesce(F.stddev_pop(r), F.lit(0.0)).alias("dispersion"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(F.abs(f"{s}.mae")).alias("mae"), F.avg(f"{s}.mfe").alias("mfe"),
            q[0].alias("q10"), q[1].alias("q50"), q[2].alias("q90"), (F.coalesce(F.stddev_pop(r), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("uncertainty"),
            *((hit(v) / total).alias(n) for v, n in (("UP_FIRST", "p_target"), ("DOWN_FIRST", "p_stop"), ("FLAT", "p_flat"), ("AMBIGUOUS", "p_ambiguous"), ("NO_TRADE", "p_no_trade"))),
            (hit("HORIZON_UP") / F.count("*")).alias("p_up"), (hit("HORIZON_DOWN") / F.count("*")).alias("p_down"),
        ).alias(s))
    out = m.groupBy(keys).agg(*aggs).where((F.col("support") >= min_support) & (F.col("decayed") >= min_decayed))
    out = out.withColumn("freshness", F.datediff("as_of", "last_day").cast("double"))
    return out if facts is None else held(out).join(memory.select("as_of", "row_id", "vector"), ["as_of", "row_id"]).drop("row_id")


def candidate_scores(queries: DataFrame, pool: DataFrame, side: str = "buy", weights: dict[str, float] | None = None) -> DataFrame:
    """Linear blend of similarity, quality, matches and history for each query (``as_of, q, qv, q_regime, q_sector``) and prototype of its date."""
    # fixed values: the weights of the blend
    w = {"similarity": 0.35, "quality": 0.15, "regime": 0.10, "sector": 0.10, "liquidity": 0.05, "support": 0.10, "mean": 0.10, "win_rate": 0.03, "uncertainty": 0.02} | (weights or {})
    both = queries.join(pool, "as_of").withColumn("similarity", V.cosine(F.col("qv"), F.col("vector")))
    same = lambda c: (F.col(f"q_{c}") == F.col(c)).cast("double")
    score = (
        w["similarity"] * F.col("similarity") + w["quality"] * F.col("quality") + w["regime"] * F.coalesce(same("regime"), F.lit(0.0)) + w["sector"] * F.coalesce(same("sector"), F.lit(0.0)) + w["liquidity"] * F.col("liquidity")
        + w["support"] * F.least(F.lit(1.0), F.col("decayed") / 5) + w["mean"] * F.col(f"{side}.mean") + w["win_rate"] * F.col(f"{side}.win_rate") - w["uncertainty"] * F.col(f"{side}.uncertainty")
    )
    return both.select("as_of", "q", "cluster", "similarity", score.alias("score"))


#: Queries of a date that a task compares with the date's prototypes, and pairs that it weighs at once.
PIECE_ROWS, PAIRS = 16_384, 1_000_000


def likely(queries: DataFrame, pool: DataFrame, top: int, temperature: float = 12.0) -> DataFrame:
    """Each query with the ``cluster`` of its ``top`` heaviest prototypes of its date, and of those that weigh the same but for rounding.

    A date's queries are dealt in pieces of bounded size, each of which meets the date's prototypes in one task; all
    pairs are weighed there and only the best leave it.
    """
    pieces = F.greatest(F.lit(1), F.ceil(F.col("__n") / PIECE_ROWS)).cast("int")
    sizes = queries.groupBy("as_of").agg(F.count("*").alias("__n")).select("as_of", pieces.alias("__pieces"))  # a row a date
    asked = queries.join(F.broadcast(sizes), "as_of").withColumn("__piece", F.pmod(F.xxhash64("q"), F.col("__pieces")).cast("int")).drop("__pieces")
    known = pool.select("as_of", "cluster", "vector", "regime", "sector", "decayed", "freshness").join(F.broadcast(sizes), "as_of")
    known = known.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))).drop("__pieces")
    wanted = queries.columns

    def units(vectors: pd.Series) -> np.ndarray:
        x = np.stack(vectors.to_numpy()).astype(float)
        n = np.sqrt((x * x).sum(axis=1))[:, None]
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in wanted} | {"cluster": []})
        a, x, y = a.reset_index(drop=True), units(a["qv"]), units(b["vector"]).T
        base = (0.45 + 0.30 * np.minimum(1.0, b["decayed"].to_numpy(float) / 5) + 0.25 / (1 + np.maximum(0.0, b["freshness"].to_numpy(float)) / 30))[None, :]
        same = []
        for c in ("regime", "sector"):  # nulls match nothing
            codes = pd.factorize(pd.concat([a[f"q_{c}"], b[c]]))[0]
            same.append((codes[: len(a)], np.where(codes[len(a) :] < 0, -2, codes[len(a) :])))
        rows, clusters, n = [], [], min(top, len(b))
        step = max(1, PAIRS // len(b))
        for lo in range(0, len(a), step):
            alike = np.zeros((len(x[lo : lo + step]), len(b)), bool)
            for q, p in same:
                alike |= q[lo : lo + step, None] == p[None, :]
            w = np.exp(temperature * (np.maximum(0.0, x[lo : lo + step] @ y) - 1)) * base * (0.40 + 0.60 * alike)
            least = np.partition(w, -n, axis=1)[:, -n]
            i, j = np.nonzero(w >= least[:, None] * (1 - 1e-9))
            rows.append(i + lo)
            clusters.append(j)
        out = a.iloc[np.concatenate(rows)][wanted]
        return out.assign(cluster=b["cluster"].to_numpy()[np.concatenate(clusters)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return asked.groupBy("as_of", "__piece").cogroup(known.groupBy("as_of", "__piece")).applyInPandas(best, f"{kinds}, cluster {dict(pool.dtypes)['cluster']}")


def distribution(queries: DataFrame, pool: DataFrame, side: str, top: int = 5, temperature: float = 12.0, bound: str = "lb_v1") -> DataFrame:
    """Mixture of each query's nearest prototypes: expected return, quantiles, effective number, bounds and utility.

    ``queries`` that have a ``cluster`` (from :func:`likely`, which does not depend on the side) are compared with that one alone.
    """
    x = lambda c: F.col(f"{side}.{c}")
    near = queries if "cluster" in queries.columns else likely(queries, pool, top, temperature)
    b = near.join(pool, ["as_of", "cluster"]).withColumn("similarity", F.greatest(F.lit(0.0), V.cosine(F.col("qv"), F.col("vector"))))
    match = lambda c: F.coalesce((F.col(f"q_{c}") == F.col(c)).cast("double"), F.lit(0.0))
    b = b.withColumns({"same_regime": match("regime"), "same": F.greatest(match("regime"), match("sector"))})
    # fixed values: the shares of support, freshness and likeness in a weight
    weight = F.exp(temperature * (F.col("similarity") - 1)) * (0.45 + 0.30 * F.least(F.lit(1.0), F.col("decayed") / 5) + 0.25 / (1 + F.greatest(F.lit(0.0), F.col("freshness")) / 30)) * (0.40 + 0.60 * F.col("same"))
    ret = (
        x("p_target") * F.greatest(x("q90"), F.lit(0.0)) + x("p_flat") * x("q50") + x("p_up") * F.greatest(x("mean"), F.lit(0.0)) - x("p_stop") * F.abs(F.least(x("q10"), F.lit(0.0))) - x("p_down") * F.abs(F.least(x("mean"), F.lit(0.0)))
        - 0.5 * x("p_ambiguous") * (F.abs(x("mae")) + F.abs(x("mfe"))) - 0.75 * x("p_no_trade") * F.abs(x("q50"))
    )
    b = b.withColumns({"w": weight, "ret": ret})
    order = Window.partitionBy("as_of", "q").orderBy(F.desc("w"), "cluster")
    kept = b.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    kept = kept.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("as_of", "q")))
    cdf = F.sum("w").over(Window.partitionBy("as_of", "q").orderBy("ret", "cluster").rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("cdf", cdf)
    mix = lambda c: F.sum(F.col("w") * c)
    q = lambda p: F.coalesce(F.min(F.when(F.col("cdf") >= p, F.col("ret"))), F.max("ret"))
    out = kept.groupBy("as_of", "q").agg(
        *(mix(x(c)).alias(c) for c in ("p_target", "p_stop", "p_flat", "p_ambiguous", "p_no_trade", "mae", "mfe", "uncertainty")), mix(F.col("ret")).alias("expected"), mix(F.col("same_regime")).alias("regime_alignment"),
        (1 / F.sum(F.col("w") * F.col("w"))).alias("n_eff"), *(q(p).alias(f"q{round(p * 100)}") for p in (0.1, 0.25, 0.5, 0.9)),
    )
    low = {"lb_v1": F.col("q10") - F.col("uncertainty"), "lb_v3": F.col("q25") - 0.5 * F.col("uncertainty"), "lb_v4": F.col("expected") - 0.5 * (F.col("q90") - F.col("q10"))}[bound]
    utility = F.col("expected") - 0.5 * F.col("mae") + 0.25 * F.col("mfe") - 0.5 * F.col("p_ambiguous") - 0.75 * F.col("p_no_trade") - F.col("uncertainty")
    return out.withColumns({"lower": low, "upper": F.col("q90") + F.col("uncertainty"), "utility": utility, "side": F.lit(side.upper())})


def gate_reasons(ess: bool = True, lower: bool = True, surface: bool = True) -> Column:
    """Reasons against a side. The switches for effective size and lower bound are separate, as each caller has its own."""
    c = F.col
    # fixed values: names of the reasons and their thresholds
    checks = [("low_ess" if surface else "low_neff", (c("n_eff") < 1.5) if ess else None), ("high_uncertainty", c("uncertainty") > 0.08), ("wide_interval", (c("q90") - c("q10") > 0.08) if surface else None), ("regime_mismatch", c("regime_alignment") < 0.5),
              ("lower_bound_non_positive", (c("lower") <= 0) if lower else None), ("low_ev", c("utility") < 0.005), ("high_ambiguous_share", (c("p_ambiguous") >= 0.30) if surface else None), ("high_no_trade_share", (c("p_no_trade") >= 0.30) if surface else None)]
    return F.array_compact(F.array(*(F.when(p, name) for name, p in checks if p is not None)))


def decisions(buy: DataFrame, sell: DataFrame, margin: float = 0.05, feasible: bool = False) -> DataFrame:
    """BUY, SELL or ABSTAIN for each query, with the reasons."""
    one = lambda d, s: d.select("as_of", "q", F.col("expected").alias(f"{s}_expected"), gate_reasons().alias(f"{s}_reasons"))
    b = one(buy, "buy").join(one(sell, "sell"), ["as_of", "q"])
    better = F.when(F.col("buy_expected") >= F.col("sell_expected"), "BUY").otherwise("SELL")
    open_buy, open_sell = F.size("buy_reasons") == 0, F.size("sell_reasons") == 0
    if feasible:
        side = F.when(open_buy & open_sell, better).when(open_buy, "BUY").when(open_sell, "SELL").otherwise("ABSTAIN")
        why = F.when(side == "ABSTAIN", F.concat(F.array(F.lit("no_feasible_side")), F.array_sort(F.array_union("buy_reasons", "sell_reasons")))).otherwise(F.array().cast("array<string>"))
        return b.select("as_of", "q", side.alias("side"), why.alias("reasons"))
    close = F.abs(F.col("buy_expected") - F.col("sell_expected")) < margin
    why = F.concat(F.when(better == "BUY", F.col("buy_reasons")).otherwise(F.col("sell_reasons")), F.when(close, F.array(F.lit("decision_margin_too_small"))).otherwise(F.array().cast("array<string>")))
    return b.select("as_of", "q", F.when(F.size(why) > 0, "ABSTAIN").otherwise(better).alias("side"), why.alias("reasons"))


#: The grid of gaps and sizes.
GAPS, SIZES = (0.002, 0.004, 0.006, 0.010, 0.015, 0.020, 0.030, 0.040, 0.050), (0.25, 0.50, 0.75, 1.00, 1.25, 1.50, 2.00)


def quote_policy(rows: DataFrame) -> DataFrame:
    """Best gap and size of a grid for each row (``q10, q50, q90, mae, mfe, atr_pct, uncertainty, n_eff, fill_proxy, cost, ev``)."""
    c = F.col

    # fixed values: the coefficients of fill, utility and bound
    def cell(gap: float, size: float) -> Column:
        fill = clip(c("fill_proxy") / (1 + 1.6 * (gap / F.greatest(c("atr_pct"), F.lit(0.002)))) * (1 - 0.35 * F.least(c("uncertainty"), F.lit(0.8))), 0.01, 0.99)
        late = 0.35 * F.greatest(F.lit(0.0), gap - F.greatest(c("mfe") * 0.35, F.lit(0.0)))
        down = F.abs(F.least(c("q10"), F.lit(0.0))) + 0.5 * F.greatest(c("mae"), F.lit(0.0))
        above = F.greatest(c("q90"), F.lit(0.0)) + 0.25 * F.greatest(c("mfe"), F.lit(0.0))
        gain = fill * (c("q50") - gap - c("cost") - late - 0.6 * down + 0.3 * above)
        bound = fill * (0.6 * c("q50") + 0.4 * c("q10") + 0.35 * F.greatest(c("mfe"), F.lit(0.0)) - 0.35 * F.greatest(c("mae"), F.lit(0.0)) - gap - c("cost")) - 0.35 * c("uncertainty")
        utility = size * F.least(F.lit(1.5), F.greatest(c("n_eff"), F.lit(0.25)) / 2) * gain - 0.10 * size * c("uncertainty")
        return F.struct(utility.alias("utility"), bound.alias("bound"), fill.alias("fill"), F.lit(-gap).alias("g"), F.lit(-size).alias("s"))

    out = rows.withColumn("b", F.array_max(F.array(*(cell(g, s) for g in GAPS for s in SIZES))))
    checks = (("utility_non_positive", (c("ev") <= 0.005) | (c("b.utility") <= 0)), ("confidence_bound_non_positive", c("b.bound") <= 0), ("low_effective_sample_size", c("n_eff") < 1.5), ("high_uncertainty", c("uncertainty") > 0.12), ("low_fill_probability", c("b.fill") < 0.10))
    why = F.array_compact(F.array(*(F.when(p, n) for n, p in checks)))
    return out.withColumns({"reasons": why, "gap": -c("b.g"), "utility": c("b.utility"), "fill_probability": c("b.fill"), "size": F.when(F.size(why) > 0, 0.0).otherwise(-c("b.s"))}).drop("b")


def baseline_gap(atr_pct: Column) -> Column:
    return F.greatest(F.lit(0.012), 0.4 * F.coalesce(F.nullif(atr_pct, F.lit(0.0)), F.lit(0.05)))


def baseline_signals(bars: DataFrame) -> DataFrame:
    """Momentum, reversal, breakout, RSI and a pseudo-random ranking for each bar; 0 where there are too few before."""
    n = F.row_number().over(by()) - 1
    move = F.col("close") - F.lag("close").over(by())
    over = lambda cond, x: F.when(cond, x).otherwise(0.0)
    out = bars.withColumns({"n": n, "move": move, "top": F.max("high").over(frame(-20, -1))})
    gain, loss = (F.sum(F.greatest(s * F.col("move"), F.lit(0.0))).over(frame(-13)) / 14 for s in (1, -1))
    back = lambda h: F.lag("close", h).over(by())
    return out.withColumns({
        "momentum_20d": over(F.col("n") >= 20, F.col("close") / back(20) - 1), "reversal_5d": over(F.col("n") >= 5, -(F.col("close") / back(5) - 1)), "breakout": over((F.col("n") >= 20) & (F.col("close") > F.col("top")), F.lit(1.0)),
        "rsi": over(F.col("n") >= 14, (50 - (100 - 100 / (1 + gain / F.greatest(loss, F.lit(1e-12))))) / 50), "random_ranking": (F.col("n") * 17) % 100 / 100.0 - 0.5,
    }).drop("move", "top")
