"""Parameter search over a grid: many trials a job, proposals by density ratio, a table of trials that a rerun continues.

A round's trials are rows beside sums of the outcomes, so a job evaluates all of them and no trial reads the outcomes
again. Between rounds the driver holds the trials alone: their number is a parameter.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import held
from .folds import STEPS
from .statistics import normal_cdf

#: Value of a trial that breaks a constraint.
INFEASIBLE = -1e9
#: Grids up to this size are listed when random draws find nothing new.
LISTED = 100_000
#: fixed values: the objective's weights and the constraints' limits
WEIGHTS = {"spread": 0.25, "calibration": 0.20, "no_trade": 0.15, "drawdown": 0.20, "allowed_drawdown": 0.15}
LIMITS = {"min_psr": 0.55, "min_dsr": 0.55, "min_filled": 1.0, "min_coverage": 0.05}


def propose(space: dict[str, Sequence], done: list[tuple[tuple, float]], count: int, seed: int, first: int = 10, share: float = 0.25, draws: int = 24) -> list[tuple]:
    """Up to ``count`` points of the grid that are not done yet; fewer only if there are no more.

    The first ``first`` are drawn evenly. After that the best ``share`` of what is done gives each parameter a density,
    the rest another; of ``draws`` points drawn from the first the one with the highest ratio of the two is taken.
    The same seed and trials give the same points.
    """
    names = sorted(space)
    values = [list(space[n]) for n in names]
    size, tried, out = math.prod(map(len, values)), {p for p, _ in done}, []
    rng = random.Random(f"{seed}:{len(done)}")
    ranked = [p for p, _ in sorted(done, key=lambda t: (-t[1], t[0]))]
    top = max(1, math.ceil(share * len(ranked)))
    density = [[_density(v, [p[i] for p in part]) for part in (ranked[:top], ranked[top:])] for i, v in enumerate(values)]
    ratio = lambda p: sum(math.log(density[i][0][x] / density[i][1][x]) for i, x in enumerate(p))
    while len(out) < count and len(tried) < size:
        if len(done) + len(out) < first:
            drawn = [tuple(rng.choice(v) for v in values) for _ in range(draws)]
        else:
            drawn = [tuple(rng.choices(v, [density[i][0][x] for x in v])[0] for i, v in enumerate(values)) for _ in range(draws)]
        new = [p for p in drawn if p not in tried]
        if not new and size <= LISTED:
            new = [p for p in product(*values) if p not in tried]
        if not new:
            continue
        best = new[0] if len(done) + len(out) < first else max(new, key=ratio)
        tried.add(best)
        out.append(best)
    return out


def _density(values: Sequence, seen: list) -> dict:
    return {v: (sum(s == v for s in seen) + 1) / (len(seen) + len(values)) for v in values}


def search(spark: SparkSession, space: dict[str, Sequence], evaluate: Callable[[DataFrame], DataFrame], trials: int, path: str, seed: int = 42, batch: int = 32) -> DataFrame:
    """Every trial, with its number, parameters and what ``evaluate`` adds to them: at least ``value``.

    ``evaluate`` gets a frame ``trial`` and a column for each parameter. Each round is written under ``path`` and is
    done only when its write is; a rerun reads the rounds there are and goes on, to the same trials as without a break.
    """
    names = sorted(space)
    kinds = ", ".join(f"{n} {'double' if any(isinstance(v, float) for v in space[n]) else 'int'}" for n in names)
    done: list[tuple[tuple, float]] = []
    rounds: list[str] = []
    while len(done) < trials:
        at = f"{path.rstrip('/')}/round-{len(rounds):05d}"
        if not _written(spark, at):
            points = propose(space, done, min(batch, trials - len(done)), seed)
            if not points:
                break
            asked = spark.createDataFrame([(len(done) + i, *p) for i, p in enumerate(points)], f"trial int, {kinds}")
            evaluate(asked).write.mode("overwrite").parquet(at)
        rounds.append(at)
        done += [(tuple(r[n] for n in names), r["value"]) for r in spark.read.parquet(at).orderBy("trial").select("value", *names).collect()]  # a batch
    return spark.read.parquet(*rounds)


def _written(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def score_prefixes(outcomes: DataFrame, fold: Column) -> DataFrame:
    """``fold, side, step`` with the sums of all plans of lower score steps, for steps from 0 to STEPS + 1.

    The outcomes are read once; what is left has STEPS + 2 rows for each fold and side. Scores are clipped to 0 to 1.
    """
    got = F.when(F.col("filled"), F.coalesce("ret", F.lit(0.0))).otherwise(0.0)
    step = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))) * STEPS).cast("int")
    rows = outcomes.select(fold.alias("fold"), "side", step.alias("step"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("filled", F.lit(False)).alias("filled"), got.alias("ret")).where("fold IS NOT NULL AND side IS NOT NULL")
    sums = {"plans": F.count("*"), "filled": F.count_if("filled"), "wins": F.count_if(F.col("filled") & (F.col("ret") > 0)), "scores": F.sum(F.when(F.col("filled"), F.col("score")).otherwise(0.0)), "total": F.sum("ret"), "squares": F.sum(F.col("ret") * F.col("ret"))}
    cells = held(rows.groupBy("fold", "side", "step").agg(*(x.alias(c) for c, x in sums.items())))
    grid = cells.select("fold", "side").distinct().select("fold", "side", F.explode(F.sequence(F.lit(0), F.lit(STEPS + 1))).alias("step"))
    before = Window.partitionBy("fold", "side").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # STEPS + 2 rows
    return held(grid.join(cells, ["fold", "side", "step"], "left").select("fold", "side", "step", *(F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(before), F.lit(0)).alias(c) for c in sums)))


def score_range_trials(prefixes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Evaluates trials ``low, width, sides`` (0: both, 1: BUY, 2: SELL): plans whose score lies in [low, low + width].

    Folds from 0 on are the discovery's, fold -1 is held out and enters no value. The value is the mean of the folds'
    expectancies less penalties for their spread, for the gap of score and hit rate, for plans without a trade, and for
    a fall of the summed returns from fold to fold; a trial that breaks a constraint, or finds
    no plans at all, has INFEASIBLE and says which.
    """
    sums = ("plans", "filled", "wins", "scores", "total", "squares")
    whole = prefixes.where(F.col("step") == STEPS + 1).groupBy("fold").agg(F.sum("plans").alias("fold_plans"))

    def evaluate(trials: DataFrame) -> DataFrame:
        sides = F.when(F.col("sides") == 1, F.array(F.lit("BUY"))).when(F.col("sides") == 2, F.array(F.lit("SELL"))).otherwise(F.array(F.lit("BUY"), F.lit("SELL")))
        lo, hi = F.round(F.col("low") * STEPS).cast("int"), F.round((F.col("low") + F.col("width")) * STEPS).cast("int")
        asked = trials.select("trial", lo.alias("lo"), (F.least(hi, F.lit(STEPS)) + 1).alias("hi"), F.explode(sides).alias("side"))
        ends = [prefixes.select("fold", "side", F.col("step").alias(e), *(F.col(c).alias(f"{e}_{c}") for c in sums)) for e in ("lo", "hi")]
        cut = asked.join(ends[0], ["side", "lo"]).join(ends[1], ["side", "hi", "fold"])
        by_fold = cut.groupBy("trial", "fold").agg(*(F.sum(F.col(f"hi_{c}") - F.col(f"lo_{c}")).alias(c) for c in sums)).join(F.broadcast(whole), "fold")  # a row a fold
        by_fold = by_fold.withColumn("mean", F.when(F.col("filled") > 0, F.col("total") / F.col("filled")).otherwise(0.0))
        order = Window.partitionBy("trial").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)  # a row a fold
        live = by_fold.where("fold >= 0").withColumn("equity", F.sum("total").over(order))
        live = live.withColumn("fall", F.greatest(F.lit(0.0), F.max("equity").over(order)) - F.col("equity"))
        held_out = by_fold.where("fold < 0").select("trial", F.col("mean").alias("holdout_expectancy"), F.col("filled").alias("holdout_filled"))
        out = live.groupBy("trial").agg(
            *(F.sum(c).alias(c) for c in (*sums, "fold_plans")), F.avg("mean").alias("expectancy"), F.coalesce(F.stddev_pop("mean"), F.lit(0.0)).alias("spread"), F.max("fall").alias("drawdown"),
        )
        out = trials.join(_value(out), "trial", "left").join(held_out, "trial", "left")
        return out.fillna(INFEASIBLE, ["value"]).withColumn("violations", F.coalesce("violations", F.array(F.lit("no_plans"))))

    return evaluate


def _value(rows: DataFrame) -> DataFrame:
    n = F.nullif(F.col("filled"), F.lit(0))

    def probability(share: float) -> Column:
        mu = F.col("total") / n * share
        var = (F.col("squares") - 2 * mu * F.col("total") + n * mu * mu) / F.nullif(n - 1, F.lit(0))
        return F.when(F.col("filled") > 1, normal_cdf(mu / (F.sqrt(F.greatest(var, F.lit(1e-12))) / F.sqrt(n)))).otherwise(0.0)

    rows = rows.withColumns({
        "coverage": F.col("filled") / F.greatest("fold_plans", F.lit(1)), "no_trade_ratio": (F.col("plans") - F.col("filled")) / F.greatest("plans", F.lit(1)),
        "calibration_error": F.coalesce(F.abs(F.col("scores") / n - F.col("wins") / n), F.lit(0.0)), "psr": probability(1.0), "dsr": probability(0.9),
    })
    checks = (("low_psr", F.col("psr") < LIMITS["min_psr"]), ("low_dsr", F.col("dsr") < LIMITS["min_dsr"]), ("low_ess", F.col("filled") < LIMITS["min_filled"]), ("low_coverage", F.col("coverage") < LIMITS["min_coverage"]))
    broken = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in checks)), lambda x: x.isNotNull())
    value = (
        F.col("expectancy") - WEIGHTS["spread"] * F.col("spread") - WEIGHTS["calibration"] * F.col("calibration_error") - WEIGHTS["no_trade"] * F.col("no_trade_ratio")
        - WEIGHTS["drawdown"] * F.greatest(F.lit(0.0), F.col("drawdown") - WEIGHTS["allowed_drawdown"])
    )
    rows = rows.withColumn("violations", broken)
    return rows.withColumn("value", F.when(F.size("violations") == 0, value).otherwise(INFEASIBLE)).drop("squares", "scores", "total", "wins")


def best(trials: DataFrame, space: dict[str, Sequence], k: int = 1) -> DataFrame:
    """The ``k`` best feasible trials, best first, ties by their parameters."""
    return trials.where(F.size("violations") == 0).orderBy(F.desc("value"), *sorted(space)).limit(k)
