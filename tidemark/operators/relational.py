"""Relational building blocks: newest rows, as-of and fallback joins, division, quotas and upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key in the given (total) order."""
    n = rank or "__rank"
    out = df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) <= k)
    return out if rank else out.drop(n)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the largest in ``order``, nulls last."""
    return top_per(df, keys, [F.col(c).desc_nulls_last() for c in order])


def newest_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Like :func:`newest` but as one aggregation with partial sums, for few columns."""
    best = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__v")).select(*keys, *(F.col(f"__v.{v}").alias(v) for v in values))


def divide(df: DataFrame, keys: Sequence[str], item: str, wanted: int | DataFrame) -> DataFrame:
    """Keys that stand with every item: ``wanted`` is the number of items or the frame that lists them."""
    if isinstance(wanted, DataFrame):
        df, wanted = df.join(wanted.select(item).distinct(), item, "left_semi"), wanted.select(item).distinct().count()
    return df.groupBy(*keys).agg(F.count_distinct(item).alias("n_items")).where(F.col("n_items") == wanted)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, values: Sequence[str], tie: Sequence[str] = (), strict: bool = False, pieces: int = 1) -> DataFrame:
    """Each left row with the values of the newest right row at or before (``strict``: before) its time.

    A union of both sides sorted once by key and time; no range join. Equal right times go to the larger ``tie``.
    Where few keys hold all rows, ``pieces`` cuts time into as many ranges of about equal counts: rows are sorted within
    a key's range, and the last right row of each range is carried into those after it, so no task holds a whole key.
    """
    names = [f"__{v}" for v in values]
    ties = [f"__tie{i}" for i in range(len(tie))]
    kinds = {f.name: f.dataType for f in right.schema}
    a = left.select(*keys, F.struct(left.columns).alias("__row"), F.col(left_at).alias("__at"), F.lit(0 if strict else 1).alias("__side"), *(F.lit(None).cast(kinds[t]).alias(n) for t, n in zip(tie, ties, strict=True)), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    b = right.select(*keys, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(right_at).alias("__at"), F.lit(1 if strict else 0).alias("__side"), *(F.col(t).alias(n) for t, n in zip(tie, ties, strict=True)), F.struct(*values).alias("__v"))
    both = a.unionByName(b)
    if pieces == 1:
        order = Window.partitionBy(*keys).orderBy("__at", "__side", *ties).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("__v", F.last("__v", ignorenulls=True).over(order)).where(F.col("__row").isNotNull())
    else:
        both = _asof_in_pieces(both, list(keys), ties, pieces)
    return both.select("__row.*", *(F.col(f"__v.{v}").alias(n) for v, n in zip(values, names, strict=True))).withColumnsRenamed({n: f"asof_{v}" for v, n in zip(values, names, strict=True)})


def range_cuts(df: DataFrame, column: str, ranges: int) -> list[float]:
    """Values that cut a numeric column into ranges of about equal counts, fewer where values repeat; none without values."""
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else None
    return sorted(set(found or []))


def _asof_in_pieces(both: DataFrame, keys: list[str], ties: list[str], pieces: int) -> DataFrame:
    """Left rows with the last right value of their key, by ranges of time; rows without a time come before all others."""
    at = F.col("__at").cast("timestamp").cast("double") if dict(both.dtypes)["__at"] in ("date", "timestamp", "timestamp_ntz") else F.col("__at").cast("double")
    both = both.withColumn("__when", at)
    cuts = range_cuts(both, "__when", pieces)
    piece = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col("__when"))), F.lit(0))
    both = both.withColumn("__piece", F.when(F.col("__when").isNull(), -1).otherwise(piece)).drop("__when")
    own = Window.partitionBy(*keys, "__piece").orderBy("__at", "__side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__v", F.last("__v", ignorenulls=True).over(own)).where(F.col("__row").isNotNull())
    ends = both.where(F.col("__v").isNotNull()).groupBy(*keys, "__piece").agg(F.max_by("__v", F.struct("__at", *ties)).alias("__end"))
    # a row for each key and piece: what is carried into a piece is the end of the last one before it that has any
    here = rows.select(*keys, "__piece", F.lit(None).cast(ends.schema["__end"].dataType).alias("__end"))
    grid = here.unionByName(ends).groupBy(*keys, "__piece").agg(F.first("__end", ignorenulls=True).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__k{i}" for i in range(len(keys))]
    carried = grid.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("__piece").alias("__p"), "__carried")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col("__piece") == F.col("__p")]
    return rows.join(carried, same, "left").withColumn("__v", F.coalesce("__v", "__carried"))


def missing(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_anti")


def present(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_semi")


def first_choice(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``first``, and the rows of ``second`` for keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti").select(first.columns))


def first_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First and last value in ``order``, and the difference, in one pass."""
    at = F.struct(*order)
    out = df.groupBy(*keys).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))
    return out.withColumn("delta", F.col("last_value") - F.col("first_value"))


def fair_quota(df: DataFrame, source: str, order: Sequence[Column], total: int) -> DataFrame:
    """Up to ``total`` rows, of which no source has more than its equal part (one at least)."""
    sources = df.select(source).distinct().count()
    return top_per(df, [source], order, max(1, total // max(sources, 1))).orderBy(*order).limit(total)


def overlaps(df: DataFrame, key: str, row: str, start: str, stop: str, span: int = 7) -> DataFrame:
    """Pairs of rows of a key whose closed intervals of days overlap, the smaller row number first.

    Intervals are dealt to the spans of ``span`` days that they touch, so rows of a key meet only in these; a pair is kept
    in the first span that both touch. Intervals that end before they begin overlap nothing.
    """
    place = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / span)
    cut = df.withColumns({"__first": place(F.col(start)), "__last": place(F.col(stop))}).where(F.col(start) <= F.col(stop))
    cut = cut.withColumn("__span", F.explode(F.sequence("__first", "__last")))
    a, b = (cut.select(key, "__span", F.col(row).alias(f"{s}_{row}"), F.col(start).alias(f"{s}_start"), F.col(stop).alias(f"{s}_stop"), F.col("__first").alias(f"__{s}")) for s in ("a", "b"))
    hit = (F.col(f"a_{row}") < F.col(f"b_{row}")) & (F.col("a_start") <= F.col("b_stop")) & (F.col("b_start") <= F.col("a_stop"))
    return a.join(b, [key, "__span"]).where(hit & (F.greatest("__a", "__b") == F.col("__span"))).drop("__span", "__a", "__b")


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the predicates that are given."""
    return reduce(lambda a, b: a & b, (p for p in predicates if p is not None), F.lit(True))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` are added where their key is new."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def upsert_with(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """Upsert column by column: ``coalesce`` (new unless null), ``greatest``, ``keep`` (old unless null), ``new``."""
    a, b = old.alias("a"), new.alias("b")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    merged = {
        "coalesce": lambda c: F.coalesce(y(c), x(c)), "keep": lambda c: F.coalesce(x(c), y(c)), "greatest": lambda c: F.greatest(x(c), y(c)),
        "new": lambda c: F.when(y(keys[0]).isNotNull(), y(c)).otherwise(x(c)),
    }
    on = [x(k) == y(k) for k in keys]
    return a.join(b, on, "full").select(*(F.coalesce(x(k), y(k)).alias(k) for k in keys), *(merged[r](c).alias(c) for c, r in rules.items()))


def upsert_counts(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How many rows of ``new`` would be inserted, changed, or left as they are."""
    joined = new.join(old.select(*keys, F.col(value).alias("__old"), F.lit(True).alias("__here")), list(keys), "left")
    here = F.coalesce("__here", F.lit(False))
    return joined.agg(
        F.count_if(~here).alias("inserted"), F.count_if(here & ~F.col("__old").eqNullSafe(F.col(value))).alias("updated"), F.count_if(here & F.col("__old").eqNullSafe(F.col(value))).alias("unchanged")
    )


def replace_members(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """The rows of every group in ``new`` take the place of that group's old rows."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is false or null."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def melt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key-value rows of all other columns: ``name``, numeric ``value`` or else ``text``."""
    cells = []
    for name, kind in df.dtypes:
        if name not in keys:
            number = kind in ("int", "bigint", "smallint", "tinyint", "float", "double", "boolean") or kind.startswith("decimal")
            value = F.col(name).cast("int").cast("double") if kind == "boolean" else F.col(name).cast("double")
            cells.append(F.struct(F.lit(name).alias("name"), (value if number else F.lit(None).cast("double")).alias("value"), (F.lit(None) if number else F.col(name)).cast("string").alias("text")))
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
