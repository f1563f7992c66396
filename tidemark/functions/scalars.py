"""Scalar column functions: guarded arithmetic, ticks, text codes and time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exchange tick ladder of the Korean market, as (price below, tick).
KR_TICKS = ((1_000, 1), (5_000, 5), (10_000, 10), (50_000, 50), (100_000, 100), (500_000, 500))
KR_TOP_TICK = 1_000
#: Canonical names of macro series.
MACRO_ALIASES = {
    "vix": "vix", "rate": "rate", "dollar": "dollar", "oil": "oil", "breadth": "breadth", "CBOE Volatility Index: VIX": "vix", "Federal Funds Effective Rate": "rate",
    "Nominal Broad U.S. Dollar Index": "dollar", "Crude Oil Prices: West Texas Intermediate (WTI) - Cushing, Oklahoma": "oil",
}


def guarded_div(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """a / b, and 0 where b is nearly zero."""
    return F.when(F.abs(b) > floor, a / b).otherwise(F.lit(0.0))


def float_div(a: Column, b: Column) -> Column:
    """a / b as floating-point arithmetic has it: by zero infinite, 0 / 0 not a number (a zero counts as positive); null for nulls."""
    return F.when(b != 0, a / b).otherwise(F.when(b == 0, a * F.lit(float("inf"))))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def or_default(x: Column, default) -> Column:
    """The default where x is null or zero."""
    return F.when(F.coalesce(x, F.lit(0)) == 0, F.lit(default)).otherwise(x)


def dead_zone_sign(x: Column, width: float = 1e-12) -> Column:
    return F.when(x > width, 1).when(x < -width, -1).otherwise(0)


def half_life(age_days: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half)


def tick_size(price: Column, market: str = "KR") -> Column:
    if market != "KR":
        return F.lit(0.01)
    out = F.lit(float(KR_TOP_TICK))
    for below, tick in reversed(KR_TICKS):
        out = F.when(price < below, float(tick)).otherwise(out)
    return out


def round_to_tick(price: Column, market: str, side: str) -> Column:
    """To a whole tick, in decimals: buys down, sells up, anything else half up. A double keeps all its digits."""
    step = tick_size(price, market).cast("decimal(10,2)")
    units = price.cast("decimal(28,14)") / step
    whole = {"BUY": F.floor(units), "SELL": F.ceil(units)}.get(side, F.round(units, 0))
    return (whole.cast("decimal(18,0)") * step).cast("double")


def quantity(budget: Column, price: Column, cap: Column | None = None) -> Column:
    """Whole units a budget buys; a cap of 0 is none."""
    units = F.when(price > 0, F.floor(budget / price)).otherwise(0).cast("long")
    units = F.greatest(units, F.lit(0).cast("long"))
    return units if cap is None else F.when(cap > 0, F.least(units, cap)).otherwise(units)


def geometric(start: Column, ratio: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start * F.pow(ratio, i))


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Linear between two points, flat outside."""
    t = clip((x - x0) / (x1 - x0), 0, 1) if x1 != x0 else F.lit(1.0)
    return y0 + (y1 - y0) * t


def symbol_dash(x: Column) -> Column:
    return F.translate(F.trim(x), "/.", "--")


def symbol_slash(x: Column) -> Column:
    return F.translate(F.trim(x), "-.", "//")


def lookup_key(x: Column) -> Column:
    return F.upper(F.trim(x))


def number(x: Column) -> Column:
    """A number written with thousands commas; null for anything else."""
    return F.regexp_replace(F.trim(x), ",", "").try_cast("double")


def flag(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "yes", "on")


def macro_name(x: Column) -> Column:
    """Canonical name of a macro series; null for one that is not known."""
    names = F.create_map(*(F.lit(v) for kv in MACRO_ALIASES.items() for v in kv))
    return F.try_element_at(names, F.trim(x))


def reject_code(code: Column, message: Column) -> Column:
    """Class of an order rejection from its text."""
    text = F.upper(F.concat_ws(" ", code, message))
    has = lambda w: text.contains(w)
    return (
        F.when(has("TIME") & has("OUT"), "TIMEOUT").when(has("PRICE") & (has("LIMIT") | has("BAND")), "PRICE_LIMIT").when(has("QTY"), "QTY").otherwise(F.substring(F.coalesce(code, F.lit("")), 1, 32))
    )


def fiscal_period(x: Column) -> tuple[Column, Column, Column]:
    """Year, quarter, and whether actual, of a heading such as ``2024.09(A)``."""
    year, month = (F.regexp_extract(x, r"^(\d{4})\.(\d{2})", g).try_cast("int") for g in (1, 2))
    return year, F.ceil(month / 3).cast("int"), ~F.regexp_like(x, F.lit(r"\(E\)"))


def close_to_utc(day: Column, clock: str, zone: str) -> Column:
    """UTC time of a local session close, daylight saving included."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lit(clock))), zone)


def local_date(ts: Column, zone: str = "Asia/Seoul") -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def fill_status(filled: Column, ordered: Column, cancelled: Column, rejected: Column) -> Column:
    return (
        F.when(rejected, "REJECTED").when(filled >= ordered, "FULL").when(filled > 0, "PARTIAL").when(cancelled, "CANCELLED").otherwise("UNFILLED")
    )
