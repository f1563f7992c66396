"""Aggregates of the research layer: weighted quantiles, mixtures, calibration and fold metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import range_cuts


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, qs: Sequence[float], tie: str | None = None, ranges: int = 64) -> DataFrame:
    """Smallest value at which the weight so far reaches each share of the total.

    Weights are first added up by value, so rows of equal value need no order and ``tie`` has no effect. Values are cut
    into ranges of about equal counts; a task sorts one range of a key, and the ranges' sums are run forward, so a key
    that holds all rows is not in one piece. Null values come before all others and are never the result.
    """
    sums = df.groupBy(*keys, F.col(value).alias("__x")).agg(F.coalesce(F.sum(weight), F.lit(0)).cast("double").alias("__w"))
    cuts = range_cuts(sums, "__x", ranges)
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col("__x").cast("double")))
    sums = sums.withColumn("__part", F.when(F.col("__x").isNull(), -1).otherwise(part))
    whole = Window.partitionBy(*keys)  # a row a range
    ends = sums.groupBy(*keys, "__part").agg(F.sum("__w").alias("__s"))
    before = F.coalesce(F.sum("__s").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    names = [f"__k{i}" for i in range(len(keys))]
    ends = ends.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("__part").alias("__p"), before.alias("__before"), F.greatest(F.sum("__s").over(whole), F.lit(1e-12)).alias("__total"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col("__part") == F.col("__p")]
    inside = F.sum("__w").over(Window.partitionBy(*keys, "__part").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    cdf = sums.withColumn("__inside", inside).join(ends, same).withColumn("__cdf", (F.col("__before") + F.col("__inside")) / F.col("__total"))
    return cdf.groupBy(*keys).agg(*(F.min(F.when(F.col("__cdf") >= q, F.col("__x"))).alias(f"q{round(q * 100)}") for q in qs))


def log_sum_exp(df: DataFrame, keys: Sequence[str], x: str, tau: float) -> DataFrame:
    """tau * log of the sum of exponentials of x / tau, taken from the largest; 1e-12 inside the logarithm.

    Equal values are counted first; the largest of each key comes by a join, so no task holds a key's rows.
    """
    counts = df.groupBy(*keys, F.col(x).alias("__x")).agg(F.count("*").alias("__n"))
    names = [f"__k{i}" for i in range(len(keys))]
    top = counts.groupBy(*keys).agg(F.max("__x").alias("__m")).withColumnsRenamed(dict(zip(keys, names, strict=True)))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    both = counts.join(top, same) if same else counts.crossJoin(top)
    out = both.groupBy(*keys).agg(F.max("__m").alias("m"), F.sum(F.col("__n") * F.exp((F.col("__x") - F.col("__m")) / tau)).alias("s"))
    return out.select(*keys, (F.col("m") / tau + F.log(F.col("s") + 1e-12)).alias("lse"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null unless the weights add up to more than zero."""
    return F.when(F.sum(weight) > 0, F.sum(value * weight) / F.sum(weight))


def scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each feature: at least 1e-8, 1 for a single row; nulls count as zero."""
    cols = []
    for f in features:
        x = F.coalesce(F.col(f), F.lit(0.0))
        cols.append(F.struct(F.lit(f).alias("feature"), F.avg(x).alias("mean"), F.when(F.count("*") == 1, 1.0).otherwise(F.greatest(F.lit(1e-8), F.stddev_pop(x))).alias("std")))
    return df.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def buckets(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    """Chunks of equal size by score, the last one short, so there may be more than ``n``.

    Ranks are built from counts of score ranges, so no task sorts all rows: ranges are cut by approximate quantiles,
    offsets of ranges are summed, and rows are ordered within their range.
    """
    cuts = sorted(set(df.approxQuantile(score, [i / 64 for i in range(1, 64)], 0.001)))
    part = F.array_position(F.transform(F.array(*map(F.lit, cuts)), lambda c: F.col(score) <= c), True) if cuts else F.lit(1)
    part = F.when(part > 0, part).otherwise(len(cuts) + 1).cast("int")
    ranged = df.withColumn("__part", part)
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}  # 64 rows at most
    before, offsets = 0, []
    for p in range(1, len(cuts) + 2):
        offsets.append(before)
        before += sizes.get(p, 0)
    size = max(1, before // n)
    place = F.row_number().over(Window.partitionBy("__part").orderBy(score, tie)) + F.get(F.array(*map(F.lit, offsets)), F.col("__part") - 1)
    return ranged.withColumn("bucket", F.floor((place - 1) / size).cast("int")).drop("__part")


def percent_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Share of the other rows with a smaller value, by counts of equal values in ranges whose offsets are summed; nulls have none.

    No task sorts more than a range. A single row has 0.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    cuts = sorted(set(counts.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.001)))
    ranged = counts.withColumn("__part", sum(((F.col(value) > c).cast("int") for c in cuts), F.lit(0)))
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.sum("__n").alias("n")).collect()}  # 64 rows at most
    offsets, total = [], 0
    for p in range(len(cuts) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    smaller = inside + F.get(F.array(*map(F.lit, offsets)), F.col("__part"))
    return df.join(ranged.select(value, (smaller / max(total - 1, 1)).alias(out)), value)


def calibration_fit(df: DataFrame, score: str, target: str) -> DataFrame:
    """Slope (ten times the regression slope, from 0.1 to 10) and intercept on the log odds."""
    x, y = F.col(score), F.col(target).cast("double")
    slope = F.when(F.var_pop(x) <= 1e-12, 1.0).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.covar_pop(x, y) / F.var_pop(x) * 10)))
    odds = F.log(F.greatest(F.lit(1e-6), F.avg(y)) / F.greatest(F.lit(1e-6), 1 - F.avg(y)))
    return df.agg(slope.alias("slope"), odds.alias("odds"), F.avg(x).alias("m")).select("slope", (F.col("odds") - F.col("slope") * F.col("m")).alias("intercept"))


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))), na_action="ignore")


def sharpe_probability(df: DataFrame, ret: str) -> DataFrame:
    """Probability that the mean return is above zero (``psr``), and of nine tenths of it about itself (``dsr``)."""
    a = df.agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.var_samp(ret).alias("var"))

    def probability(share: float) -> Column:
        mu, n = F.col("mean") * share, F.col("n")
        var = F.greatest(F.col("var") + n * F.pow(F.col("mean") - mu, 2) / (n - 1), F.lit(1e-12))
        return F.when(n > 1, normal_cdf(mu / F.sqrt(var / n))).otherwise(0.0)

    return a.select("n", probability(1.0).alias("psr"), probability(0.9).alias("dsr"))


def combinatorial_folds(n_dates: int, groups: int, tests: int, purge: int) -> list[dict]:
    """Every choice of ``tests`` of ``groups`` equal date blocks as a test set; training dates within ``purge`` of one are left out."""
    from itertools import combinations

    edges = [round(i * n_dates / groups) for i in range(groups + 1)]
    out = []
    for fold, chosen in enumerate(combinations(range(groups), tests)):
        test = [d for g in chosen for d in range(edges[g], edges[g + 1])]
        near = {d + k for d in test for k in range(-purge, purge + 1)}
        out.append({"fold": fold, "train": [d for d in range(n_dates) if d not in near], "test": test})
    return out


def overlap_adjusted_size(pairs: int, n: int) -> float:
    """Sample size after a penalty for overlapping pairs."""
    return float(n) if n <= 1 else n / (1 + pairs / n)


def rejections(metrics: dict) -> list[str]:
    """Why a run's metrics are not good enough."""
    checks = (
        ("non_positive_expectancy", metrics.get("expectancy_after_cost", 0.0) <= 0), ("low_psr_or_dsr", max(metrics.get("psr", 0.0), metrics.get("dsr", 0.0)) < 0.55),
        ("non_monotonic_score_buckets", not metrics.get("score_decile_monotonicity", False)), ("high_calibration_error", metrics.get("calibration_error", 1.0) > 0.25),
    )
    return [name for name, holds in checks if holds]


def walk_forward(n_dates: int, train: int, test: int, purge: int, embargo: int = 0) -> list[dict]:
    """Folds as half-open ranges of date ordinals; training ends ``purge`` dates before testing begins."""
    folds, start = [], train + purge
    while start + test <= n_dates:
        folds.append({"fold": len(folds), "train_from": max(0, start - purge - train), "train_to": start - purge, "test_from": start, "test_to": start + test})
        start += test + embargo
    return folds
