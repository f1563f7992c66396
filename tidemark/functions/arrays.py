"""Vector functions over ``array<double>`` columns, as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, however often (or in which lambda) ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Signed cosine; 0 where a vector has no length."""
    scale = norm(x) * norm(y)
    return F.when(scale > 0, dot(x, y) / scale).otherwise(F.lit(0.0))


def cosine_clipped(x: Column, y: Column) -> Column:
    """Cosine from 0 up; 0 where lengths differ."""
    return F.when(F.size(x) == F.size(y), F.greatest(F.lit(0.0), cosine(x, y))).otherwise(F.lit(0.0))


def dot_truncated(x: Column, y: Column) -> Column:
    """Inner product over the shorter vector's components."""
    n = F.least(F.size(x), F.size(y))
    return F.when(n > 0, dot(F.slice(x, F.lit(1), F.greatest(n, F.lit(1))), F.slice(y, F.lit(1), F.greatest(n, F.lit(1))))).otherwise(F.lit(0.0))


def unit(x: Column) -> Column:
    """Scaled to length one in single precision; nulls and not-a-numbers count as 0, a zero vector stays."""
    clean = F.transform(x, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))
    scaled = lambda y, n: F.transform(y, lambda v: F.when(n > 0, v / n).otherwise(v).cast("float"))
    return once(clean, lambda y: once(norm(y), lambda n: scaled(y, n)))


def mean(x: Column) -> Column:
    return once(x, lambda y: total(y) / F.size(y))


def std(x: Column) -> Column:
    """Population standard deviation."""
    return once(x, lambda y: once(mean(y), lambda m: F.sqrt(total(F.transform(y, lambda v: (v - m) * (v - m))) / F.size(y))))


def standardise(x: Column, limit: float = 5.0, floor: float = 1e-8) -> Column:
    def scaled(y: Column, m: Column, s: Column) -> Column:
        return F.transform(y, lambda v: F.when(s < floor, F.lit(0.0)).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), (v - m) / s))))

    return once(x, lambda y: once(F.struct(mean(y).alias("m"), std(y).alias("s")), lambda c: scaled(y, c["m"], c["s"])))


def resample(x: Column, m: int) -> Column:
    """``m`` values by linear interpolation between the first and the last."""

    def at(x: Column, i: Column) -> Column:
        place = i * (F.size(x) - 1) / max(m - 1, 1)
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.size(x) - 1)
        return F.get(x, low) + (F.get(x, high) - F.get(x, low)) * (place - low)

    return once(x, lambda y: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: at(y, i)))


def segment_means(x: Column, m: int) -> Column:
    """Piecewise aggregate approximation; null where there are fewer than ``m`` values."""

    def seg(x: Column, i: Column) -> Column:
        a, b = F.floor(i * F.size(x) / m).cast("int"), F.floor((i + 1) * F.size(x) / m).cast("int")
        return mean(F.slice(x, a + 1, b - a))

    return once(x, lambda y: F.when(F.size(y) >= m, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: seg(y, i))))


def fit_length(x: Column, n: int) -> Column:
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


def usable(x: Column, bound: float = 10.0, least_std: float = 1e-6, least_distinct: float = 0.15) -> Column:
    """Finite, bounded, spread out, and not of a few repeated values only."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= bound))
    varied = F.size(F.array_distinct(F.transform(x, lambda v: F.round(v, 6)))) / F.size(x) >= least_distinct
    return F.when(F.size(x) > 0, finite & (std(x) >= least_std) & varied).otherwise(F.lit(False))


def from_text(x: Column) -> Column:
    """A vector written as ``[1.0,2.0]`` or ``(1.0,2.0)``."""
    return F.from_json(F.translate(x, "()", "[]"), "array<double>")


def longest_rise(x: Column) -> Column:
    """Most consecutive positive values."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, v: Column) -> Column:
        run = F.when(v > 0, a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(x, start, step, lambda a: a["best"])


def ewm_last(x: Column, span: int) -> Column:
    """Last value of the exponentially weighted mean with adjusted weights."""
    alpha = 2.0 / (span + 1)
    sums = F.aggregate(x, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")), lambda a, v: F.struct((a["n"] * (1 - alpha) + v).alias("n"), (a["d"] * (1 - alpha) + 1).alias("d")))
    return sums["n"] / sums["d"]


def worst_fall(x: Column) -> Column:
    """Deepest fall from the running peak, as a share of the peak (0 or less)."""
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(a: Column, v: Column) -> Column:
        peak = F.greatest(F.coalesce(a["peak"], v), v)
        return F.struct(peak.alias("peak"), F.least(a["worst"], F.when(peak != 0, v / peak - 1).otherwise(0.0)).alias("worst"))

    return F.aggregate(x, start, step, lambda a: a["worst"])
