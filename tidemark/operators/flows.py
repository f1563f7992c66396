"""Composite flows: recommendation candidates, context vectors, reranked signals, fold validation, coverage and planning views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as V
from .relational import top_per


def best_signals(signals: DataFrame, recommendations: DataFrame, key: str, least: float, limit: int, selling: bool = False) -> DataFrame:
    """The strongest signals of a side (``signal``), with a flag for standing LONG recommendations and without keys that have a SHORT one.

    The list is cut to ``limit`` rows: it is a report. Ties go to the smaller key.
    """
    strong = signals.where(F.col("signal") <= -least if selling else F.col("signal") >= least)
    of = lambda side: recommendations.where(F.col("side") == side).select(key).distinct()
    flagged = strong.join(of("SHORT"), key, "left_anti").join(of("LONG").withColumn("has_long", F.lit(True)), key, "left")
    return flagged.withColumn("has_long", F.coalesce("has_long", F.lit(False))).orderBy(F.abs("signal").desc(), key).limit(limit)


def reported_and_upcoming(reports: DataFrame, key: str, at: str, estimate: str, cut: Column) -> DataFrame:
    """Each key's latest dated report up to ``cut``, and its next one: the nearest dated after it, else an undated one."""
    past = reports.where(F.col(at) <= cut).groupBy(key).agg(F.max_by(estimate, F.struct(at, estimate)).alias("reported"), F.max(at).alias("reported_at"))
    ahead = reports.where(F.col(at).isNull() | (F.col(at) > cut)).groupBy(key).agg(
        F.min_by(F.when(F.col(at).isNotNull(), F.struct(at, estimate)), F.when(F.col(at).isNotNull(), F.struct(at, estimate))).alias("dated"), F.min(F.when(F.col(at).isNull(), F.col(estimate))).alias("undated")
    )
    out = past.join(ahead, key, "full")
    return out.select(key, "reported", "reported_at", F.coalesce(F.col(f"dated.{estimate}"), "undated").alias("upcoming"), F.col(f"dated.{at}").alias("upcoming_at"))


def last_two_before(days: DataFrame, observed: DataFrame, series: Sequence[str]) -> DataFrame:
    """For each day and series, the last two observations (``name, day, value``) strictly before the day: ``last`` and ``before``.

    Observations carry their own predecessor; a day then takes the newest one before it from one sort by name and day.
    """
    pair = F.struct(F.col("value").alias("last"), F.lag("value").over(Window.partitionBy("name").orderBy("day")).alias("before"))
    seen = observed.withColumn("pair", pair).select("name", "day", "pair", F.lit(1).alias("side"))
    names = F.explode(F.array(*map(F.lit, series)))
    asked = days.select(names.alias("name"), "day").withColumn("pair", F.lit(None).cast(seen.schema["pair"].dataType)).withColumn("side", F.lit(0))
    so_far = Window.partitionBy("name").orderBy("day", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(seen).withColumn("known", F.last("pair", ignorenulls=True).over(so_far))
    return both.where("side = 0").select("name", "day", "known.last", "known.before")


def context_vectors(days: DataFrame, observed: DataFrame, breadth: DataFrame, series: Sequence[str], weight: float = 1.0, dim: int | None = None) -> DataFrame:
    """A unit vector for each day: the log change of each series' last two observations, and weighted breadth before the day.

    ``breadth`` (``day, breadth``) is taken as of the last day before. A series without two positive observations counts
    as 0. The vector is padded or cut to ``dim``.
    """
    two = last_two_before(days, observed, series)
    change = F.when((F.col("last") > 0) & (F.col("before") > 0), F.log("last") - F.log("before")).otherwise(0.0)
    per = two.withColumn("change", change).groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("name", "change"))).alias("changes"))  # one a series
    wide = last_two_before(days, breadth.select(F.lit("breadth").alias("name"), "day", F.col("breadth").alias("value")), ["breadth"]).select("day", F.col("last").alias("breadth"))
    raw = F.array(*(F.coalesce(F.try_element_at("changes", F.lit(s)), F.lit(0.0)) for s in sorted(series)), F.coalesce("breadth", F.lit(0.0)) * weight)
    raw = raw if dim is None else V.fit_length(raw, dim)
    scaled = V.once(raw, lambda v: V.once(V.norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))
    return per.join(wide, "day").select("day", scaled.alias("vector"))


def reranked(matches: DataFrame, alpha: float, beta: float, k: int) -> DataFrame:
    """The ``k`` best matches of each query and direction by shape and context similarity, weighted as ``alpha`` to ``beta``, as ``sim``."""
    whole = alpha + beta if alpha + beta > 0 else 1.0
    scored = matches.withColumn("sim", alpha / whole * F.col("shape_sim") + beta / whole * F.col("ctx_sim"))
    return top_per(scored, ["q", "direction"], [F.desc("sim"), F.col("id")], k, "rank")


def fold_validation(rows: DataFrame, folds: DataFrame, day: str, value: str) -> DataFrame:
    """Each fold's scaler from its training days and score on its test days, and whether all training came before.

    ``folds`` has ``fold, train_from, train_to, test_from, test_to`` (half-open days). Sums by day are joined to the
    folds' ranges, one row a day, so no row of data is copied for each fold.
    """
    daily = rows.groupBy(day).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    d = F.col(day)
    in_train, in_test = (d >= F.col("train_from")) & (d < F.col("train_to")), (d >= F.col("test_from")) & (d < F.col("test_to"))
    part = lambda inside, c: F.sum(F.when(inside, F.col(c)))
    out = F.broadcast(folds).join(daily, in_train | in_test).groupBy("fold").agg(  # a row a fold
        part(in_train, "n").alias("train_n"), part(in_test, "n").alias("test_n"), (part(in_train, "s") / part(in_train, "n")).alias("train_mean"), (part(in_test, "s") / part(in_test, "n")).alias("test_mean"),
        part(in_train, "q").alias("q"), F.max(F.when(in_train, d)).alias("last_train"), F.min(F.when(in_test, d)).alias("first_test"),
    )
    std = F.sqrt(F.greatest(F.col("q") / F.col("train_n") - F.col("train_mean") * F.col("train_mean"), F.lit(0.0)))
    return out.withColumn("train_std", F.greatest(std, F.lit(1e-8))).withColumn("leak_free", F.col("last_train") < F.col("first_test")).drop("q")


def fold_objective(folds: DataFrame, spread: float = 0.5) -> DataFrame:
    """Mean of the folds' test means less ``spread`` times their population deviation, and whether no fold leaks."""
    return folds.agg((F.avg("test_mean") - spread * F.coalesce(F.stddev_pop("test_mean"), F.lit(0.0))).alias("objective"), F.every("leak_free").alias("all_leak_free"), F.count("*").alias("folds"))


def coverage_score(zero_share: Column, filled_share: Column, macro_share: Column, own_proxy: Column) -> Column:
    """From 1 down: features that are zero by default, filled by zero, missing macro series, and a sector without other members."""
    # fixed values: the weights
    return F.greatest(F.lit(0.0), 1 - (0.35 * zero_share + 0.35 * filled_share + 0.20 * (1 - macro_share) + F.when(own_proxy, 0.25).otherwise(0.0)))


def matched_prototypes(matches: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """How often each prototype was matched and the means over its matches; missing values count as zero."""
    return matches.groupBy(*keys).agg(F.count("*").alias("match_count"), *(F.avg(F.coalesce(F.col(v), F.lit(0.0))).alias(f"mean_{v}") for v in values))


def chosen_side_metric(panel: DataFrame, side: str, buy: str, sell: str) -> Column:
    return F.when(F.col(side) == "BUY", F.col(buy)).when(F.col(side) == "SELL", F.col(sell))


def config_id(*parts: Column, digits: int = 16) -> Column:
    """A deterministic id of a configuration: the beginning of a hash of its parameters as text."""
    return F.left(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), F.lit(digits))


def get_or_create(configs: DataFrame, wanted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Ids of the wanted parameter tuples, and whether each is new; ids follow from the parameters, so a rerun finds them."""
    ask = wanted.select(*names).distinct().withColumn("config_id", config_id(*map(F.col, names)))
    here = configs.select(*names).distinct().withColumn("config_id", config_id(*map(F.col, names))).select("config_id", F.lit(False).alias("is_new"))
    return ask.join(here, "config_id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(True)))


def session_flags(seconds: Column, start: int, close: int, near: int = 10) -> dict[str, Column]:
    """Where a second of the day stands in a session: first hour, last hour, near the close, after it."""
    left = F.lit(close) - seconds
    return {"first_hour": (seconds - start).between(0, 3600), "last_hour": left.between(0, 3600), "near_close": left.between(0, near * 60), "after_close": seconds > close}


def core_of_chunks(signals: DataFrame, core_start: str, core_stop: str, keys: Sequence[str]) -> DataFrame:
    """Signals found in overlapping chunks: those inside their chunk's core, once each."""
    inside = (F.col("at") >= F.col(core_start)) & (F.col("at") < F.col(core_stop))
    return signals.where(inside).dropDuplicates(list(keys))


def apply_once(patches: DataFrame, log: DataFrame) -> DataFrame:
    """Patches whose text has not been applied yet: those whose checksum the log lacks."""
    return patches.withColumn("checksum", F.sha2("body", 256)).join(log.select("checksum").distinct(), "checksum", "left_anti")


def audit(rows: DataFrame, text: str, large: int) -> DataFrame:
    """Size of each payload and what to do with it."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return rows.withColumn("bytes", size.cast("long")).withColumn("advice", F.when(size == 0, "drop").when(size > large, "prune").otherwise("keep"))

