"""Shape vectors of price paths, built from arrays of a path's bars with array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays as V


def steps(x: Column) -> Column:
    """Differences of neighbours."""
    return V.once(x, lambda y: F.transform(F.sequence(F.lit(1), F.size(y) - 1), lambda i: F.get(y, i) - F.get(y, i - 1)))


def log_steps(x: Column, add: float = 0.0, floor: float | None = None) -> Column:
    """Differences of logarithms of x + ``add``, or of x but ``floor`` at least."""
    return steps(F.transform(x, lambda v: F.log(F.greatest(v, F.lit(floor)) if floor is not None else v + add)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's; 0 where it is undefined."""
    square = lambda c: V.total(F.transform(c, lambda v: v * v))

    def of(a: Column, b: Column) -> Column:
        scale = F.sqrt(square(a) * square(b))
        return F.when((F.size(a) > 1) & (scale > 0), V.dot(a, b) / scale).otherwise(0.0)

    return V.once(F.struct(_centred(x).alias("x"), _centred(y).alias("y")), lambda c: of(c["x"], c["y"]))


def _centred(x: Column) -> Column:
    return V.once(x, lambda y: V.once(V.mean(y), lambda m: F.transform(y, lambda v: v - m)))


def ordinal_ranks(x: Column) -> Column:
    """Place of each value in ascending order; values that are equal to twelve digits in order of appearance.

    Differences of logarithms that are the same number come out a last bit apart, on each machine another one.
    """
    ordered = F.array_sort(F.transform(x, lambda v, i: F.struct(F.round(v * 1e12).alias("v"), i.alias("i"))))
    back = F.array_sort(F.transform(ordered, lambda p, rank: F.struct(p["i"].alias("i"), rank.alias("rank"))))
    return F.transform(back, lambda p: p["rank"].cast("double"))


def spearman(x: Column, y: Column) -> Column:
    return F.when(F.size(x) == F.size(y), correlation(ordinal_ranks(x), ordinal_ranks(y))).otherwise(0.0)


def slope(x: Column) -> Column:
    """Least-squares slope over the places 0, 1, 2, ..."""
    n = F.size(x)
    middle = (n - 1) / 2.0
    num = V.total(F.transform(x, lambda v, i: (i - middle) * v))
    return F.when(n > 1, num / (n * (n * n - 1) / 12.0)).otherwise(0.0)


def path_meta(moves: Column, volumes: Column) -> list[Column]:
    """Realised and downside volatility, share and longest run of rises, lag-one correlation, slope, rank correlation with volume."""
    n = F.size(moves)
    square = lambda x: V.total(F.transform(x, lambda v: v * v))
    return [
        F.sqrt(square(moves) / n), F.sqrt(square(F.transform(moves, lambda v: F.least(v, F.lit(0.0)))) / n), F.size(F.filter(moves, lambda v: v > 0)) / n, V.longest_rise(moves).cast("double"),
        F.when(n > 2, correlation(F.slice(moves, F.lit(1), n - 1), F.slice(moves, F.lit(2), n - 1))).otherwise(0.0), slope(moves), spearman(moves, volumes),
    ]


def _weighted(x: Column, w: float) -> Column:
    return F.transform(x, lambda v: v * w)


def shape_v1(closes: Column, volumes: Column, m: int = 5, w_seq: float = 1.0, w_meta: float = 0.5) -> Column:
    """2m + 7 values: standardised and resampled price and volume moves, and squashed path features."""

    def vector(moves: Column, flows: Column) -> Column:
        sequences = [_weighted(V.resample(V.standardise(x), m), w_seq) for x in (moves, flows)]
        return F.concat(*sequences, F.array(*(F.tanh(v) * w_meta for v in path_meta(moves, flows))))

    series = F.struct(log_steps(closes, 1e-9).alias("moves"), log_steps(volumes, 1.0).alias("flows"))
    return F.when(F.size(closes) >= 3, V.once(series, lambda s: vector(s["moves"], s["flows"])))


def candles(opens: Column, highs: Column, lows: Column, closes: Column) -> dict[str, Column]:
    """Body, shadows and range of each candle as shares of its open."""
    bars = F.arrays_zip(opens.alias("o"), highs.alias("h"), lows.alias("l"), closes.alias("c"))
    base = lambda b: b["o"] + 1e-9
    return {
        "body": F.transform(bars, lambda b: (b["c"] - b["o"]) / base(b)), "up": F.transform(bars, lambda b: (b["h"] - F.greatest(b["o"], b["c"])) / base(b)),
        "down": F.transform(bars, lambda b: (F.least(b["o"], b["c"]) - b["l"]) / base(b)), "range": F.transform(bars, lambda b: (b["h"] - b["l"]) / base(b)),
    }


def shape_v2(opens: Column, highs: Column, lows: Column, closes: Column, volumes: Column, m: int = 5, w_meta: float = 0.5) -> Column:
    """6m + 10 values: :func:`shape_v1`'s sequences, four of candle changes, and candle features among the rest."""

    def vector(c: Column) -> Column:
        moves, flows, body, reach = c["moves"], c["flows"], c["body"], c["range"]
        sequences = [V.resample(V.standardise(x), m) for x in (moves, flows, body, c["up"], c["down"], reach)]
        thin = F.size(F.filter(F.zip_with(body, reach, lambda b, r: F.abs(b) <= 0.1 * (r + 1e-9)), lambda x: x)) / F.size(body)
        lean = V.mean(F.zip_with(c["up"], c["down"], lambda a, b: a - b))
        meta = [*path_meta(moves, flows), thin, lean, spearman(F.transform(body, F.abs), reach)]
        return F.concat(*sequences, F.array(*(F.tanh(v) * w_meta for v in meta)))

    changes = {k: steps(v) for k, v in candles(opens, highs, lows, closes).items()}
    series = {"moves": log_steps(closes, 1e-9), "flows": log_steps(volumes, 1.0)} | changes
    return F.when(F.size(closes) >= 3, V.once(F.struct(*(v.alias(k) for k, v in series.items())), vector))


def premarket_shape(opens: Column, highs: Column, lows: Column, closes: Column, volumes: Column, m: int, w_price: float = 1.0, w_volume: float = 1.0, w_candle: float = 1.0, w_meta: float = 1.0) -> Column:
    """Unit vector of segment means: price and volume moves, three candle series, range and mean true range of seven."""
    bars = F.arrays_zip(opens.alias("o"), highs.alias("h"), lows.alias("l"), closes.alias("c"))
    safe = lambda b: F.greatest(F.abs(b["c"]), F.lit(1e-9))
    before = lambda i: F.get(closes, F.greatest(i - 1, F.lit(0)))
    true = F.transform(bars, lambda b, i: F.greatest(b["h"] - b["l"], F.abs(b["h"] - before(i)), F.abs(b["l"] - before(i))))
    seven = lambda t, i: F.slice(t, F.greatest(i - 6, F.lit(0)) + 1, F.least(i + 1, F.lit(7)))
    mean_range = V.once(true, lambda t: F.transform(bars, lambda b, i: V.mean(seven(t, i)) / safe(b)))
    series = [
        (log_steps(closes, floor=1e-9), w_price), (log_steps(volumes, floor=1.0), w_volume), (F.transform(bars, lambda b: (b["c"] - b["o"]) / safe(b)), w_candle), (F.transform(bars, lambda b: (b["h"] - F.greatest(b["o"], b["c"])) / safe(b)), w_candle),
        (F.transform(bars, lambda b: (F.least(b["o"], b["c"]) - b["l"]) / safe(b)), w_candle), (F.transform(bars, lambda b: (b["h"] - b["l"]) / safe(b)), w_meta), (mean_range, w_meta),
    ]
    return V.unit(F.concat(*(_weighted(V.segment_means(x, m), w) for x, w in series if w > 0)))


BUILDERS = {"v1": shape_v1, "v2": shape_v2, "premarket": premarket_shape}
