"""Vector search and similarity signals; exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..session import held
from .relational import top_per

MAX_BROADCAST_VECTORS = 20_000
#: Pool vectors compared at once with so many queries; a task holds up to TILES times that (or WIDTH bytes of components).
TILE, CHUNK, TILES, WIDTH = 16_384, 64, 8, 64 << 20
#: Pool vectors with which the first bounds of queries are found.
FIRST = 512


def similarities(queries: DataFrame, pool: DataFrame, measure=V.cosine) -> DataFrame:
    """Every stated query (``q``, ``qv``) against every other vector (``id``, ``v``): ``q``, ``id``, ``sim`` and the rest.

    Queries are broadcast if few enough, else dealt in blocks; either way the pool is read in one pass a block.
    """
    n = queries.count()
    blocks = max(1, -(-n // MAX_BROADCAST_VECTORS))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        asked = part.agg(F.collect_list(F.struct(*part.columns)).alias("asked"))  # MAX_BROADCAST_VECTORS rows at most
        each = pool.join(F.broadcast(asked)).withColumn("a", F.explode("asked")).drop("asked").where(F.col("a.q") != F.col("id"))
        each = each.select(*(F.col(f"a.{c}").alias(c) for c in part.columns if c != "qv"), *(c for c in pool.columns if c != "v"), measure(F.col("a.qv"), F.col("v")).alias("sim"))
        out = each if out is None else out.unionByName(each)
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(column), -1)


def _matching(a: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int, slack: float, barred: Callable[[np.ndarray], None] | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose rough similarity is not below its query's bound (or, without one yet, the ``k``-th best of these)."""
    near = a @ x.T
    if barred:
        barred(near)
    least = bound - slack
    new = np.flatnonzero(bound == -np.inf)
    if len(new):
        width = min(k, near.shape[1])
        least[new] = np.partition(near[new], -width, axis=1)[:, -width] - 2 * slack
    return np.nonzero((near >= least[:, None].astype(near.dtype)) & (near > -np.inf))


def _best(asked: Callable[[], tuple[np.ndarray, np.ndarray, np.ndarray | None]], k: int, per: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best of a task's rows for each query, equal ones in order of ``id``; of queries with a day, those ``known`` before it.

    Products in single precision sort out what cannot be among the best found so far; what is left is worked out pair by pair.
    """

    def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.sqrt((x * x).sum(axis=1))
        return n, np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0)

    def usable(x: np.ndarray) -> np.ndarray:
        return ~np.isinf(x).any(axis=1) | np.isnan(x).any(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = [b for b in batches if b.num_rows]
        if not tile:
            return
        rows = pa.Table.from_batches(tile).sort_by("id")
        x, (q, a, day) = _matrix(rows["v"]), asked()
        rows = rows.drop_columns("v")
        whole = usable(x)
        if not whole.all():
            rows, x = rows.filter(pa.array(whole)), x[whole]
        keep, known = usable(a), None
        if day is not None and len(x):
            known = rows["known"].cast(pa.int32()).to_numpy()
            keep &= day > known.min()
            day = day[keep]
        q, a = q[keep], a[keep]
        if not len(x) or not len(q):
            return
        for y in (x, a):
            y[np.isnan(y).any(axis=1)] = 0  # without a length, as similar as a zero vector
        (n, u), (an, au) = scaled(x), scaled(a)
        slack = (x.shape[1] + 4) * 2.0**-22  # twice what single precision can be off, and more
        side = rows[per].to_numpy() if per else np.zeros(len(x))
        sides = [np.flatnonzero(side == v) for v in set(side)]
        sides = [(c, u[c].astype(np.float32)) for c in sides]
        ends = [FIRST]
        while ends[-1] < len(x):
            ends.append(ends[-1] + min(3 * ends[-1], TILE))
        for lo in range(0, len(q), CHUNK):
            part, rough = slice(lo, lo + CHUNK), au[lo : lo + CHUNK].astype(np.float32)
            for cols, ru in sides:
                bound = np.full(len(rough), -np.inf)
                bi, bj, bs = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
                for start, end in zip([0, *ends], ends, strict=False):
                    c = cols[start:end]
                    if not len(c):
                        break

                    def barred(near: np.ndarray, c=c, part=part) -> None:
                        near[known[c][None, :] >= day[part, None]] = -np.inf

                    bar = barred if known is not None else None
                    i, j = _matching(rough, ru[start:end], bound, k, slack, bar)
                    if len(i) > 16 * k * len(rough):  # many nearly as near: a narrower bound
                        i, j = _matching(au[part], u[c], bound, k, 1e-12, bar)
                    if not len(i):
                        continue
                    j = c[j]
                    dot = np.zeros(len(i))  # again for each pair by itself, so that equal vectors are equally near
                    for at in range(0, len(i), 50_000):
                        p = slice(at, at + 50_000)
                        dot[p] = (a[lo + i[p]] * x[j[p]]).sum(axis=1)
                    scale = an[lo + i] * n[j]
                    sim = np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
                    i, j, sim = np.concatenate([bi, i]), np.concatenate([bj, j]), np.concatenate([bs, sim])
                    order = np.lexsort((j, -sim, i))
                    i, j, sim = i[order], j[order], sim[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    bound[i[place == k - 1]] = sim[place == k - 1]
                    first = place < k
                    bi, bj, bs = i[first], j[first], sim[first]
                out = rows.take(pa.array(bj))
                for b in out.add_column(0, "q", pa.array(q[lo + bi])).append_column("sim", pa.array(bs)).combine_chunks().to_batches():
                    yield b

    return run


def _of_classes(near: DataFrame, own: list[str], k: int) -> DataFrame:
    """One row for each class of queries (and value of ``own``): the first ``k`` + 1 rows of its best classes, best first."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.isnull("id").alias("last"), "id", "sim", "members")))  # k + 1 classes a task
    near = near.groupBy("q", *own).agg(F.slice(best, 1, k + 1).alias("best"))
    rows = F.transform("best", lambda c: F.transform(c["members"], lambda m: F.struct(c["far"].alias("far"), m["last"].alias("last"), m["id"].alias("id"), c["sim"].alias("sim"), m.alias("row"))))
    return near.select("q", *own, F.slice(F.sort_array(F.flatten(rows)), 1, k + 1).alias("best"))


def nearest(queries: DataFrame, pool: DataFrame, k: int, per: str | None = None, timed: bool = False) -> DataFrame:
    """Like :func:`similarities` by cosine, but only the ``k`` best for a query (and value of ``per``), equal ones in order of ``id``.

    Equal vectors are one class: each different vector is asked with once, against each different vector once. A class
    stands for its ``k`` + 1 first rows, as a query is not its own neighbour, so that no row among the best is lost.
    Vectors with a component that is null or not a number are as similar as zero vectors, infinite ones take no part. The driver sends one block of queries at a
    time; of several, each block's rows are written before the next is sent. The work is all pairs of different vectors,
    in matrix products.

    ``timed``: queries have a day ``at``, the pool a day ``known``, and a query sees what was known before its day. The
    pool is then cut into tiles along ``known`` (and ``id``, so a day may have many tiles); a tile is compared with later
    queries alone, and no row of the pool is copied for a date. Classes are of equal vectors and days.
    """
    spark, rest = pool.sparkSession, [c for c in pool.columns if c != "v"]
    own, day = ([per] if per else []), (["known"] if timed else [])
    asking = ["qv", *(["at"] if timed else [])]
    queries = held(queries.select("q", *asking).where(" AND ".join(f"{c} IS NOT NULL" for c in ("q", *asking))))
    pool = pool.select(*rest, "v").where(" AND ".join(f"{c} IS NOT NULL" for c in ("v", *(day or ["id"]))))
    heads = held(queries.groupBy(*asking).agg(F.count("*").alias("rows")).select(F.monotonically_increasing_id().alias("q"), *asking))
    by = ["v", *own, *day]
    row = F.struct(F.isnull("id").alias("last"), *(F.col(c) for c in ("id", *(c for c in rest if c != "id"))))
    classes = held(top_per(pool, by, [F.col("id").asc_nulls_last()], k + 1).groupBy(*by).agg(F.min("id").alias("id"), F.sort_array(F.collect_list(row)).alias("members")))  # k + 1 rows a class
    kinds = dict(classes.dtypes)
    kept = [*(c for c in rest if c in ("id", *own, *day)), "members"]
    schema = "q long, " + ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sim double"
    size = classes.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("width")).first()
    most = max(1, min(TILES * TILE, max(TILE, WIDTH // (8 * (size["width"] or 1)))))
    count = max(1, -(-size["rows"] // most), min(-(-size["rows"] // max(1, TILE // 8)), spark.sparkContext.defaultParallelism))
    classes = classes.select(*kept, "v")
    tiles = classes.repartitionByRange(count, "known", "id") if timed else classes.repartition(count)
    blocks = max(1, -(-heads.count() // MAX_BROADCAST_VECTORS))
    out = None
    for b in range(blocks):
        part = (heads if blocks == 1 else heads.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).toArrow()  # about MAX_BROADCAST_VECTORS rows
        days = part["at"].cast(pa.int32()).to_numpy() if timed else None
        shared = spark.sparkContext.broadcast((part["q"].to_numpy(), _matrix(part["qv"]) if part.num_rows else np.zeros((0, 1)), days))
        each = _of_classes(tiles.mapInArrow(_best(lambda shared=shared: shared.value, k + 1, per), schema), own, k)
        if blocks > 1:
            each = held(each)
            shared.destroy()
        out = each if out is None else out.unionByName(each)
    found = queries.join(heads.withColumnRenamed("q", "head").join(out.withColumnRenamed("q", "head"), "head"), asking)
    others = F.filter("best", lambda m: ~m["id"].eqNullSafe(F.col("q")))
    found = found.select("q", F.explode(F.slice(others, 1, k)).alias("m"))
    return found.select("q", *(F.col(f"m.row.{c}").alias(c) for c in rest), "m.sim")


def top_similar(sims: DataFrame, keys: list[str], k: int, rank: str = "rank") -> DataFrame:
    return top_per(sims, keys, [F.desc("sim"), F.col("id")], k, rank)


def kernel_mixture(top: DataFrame, temperature: float, value: Column) -> DataFrame:
    """Weights exp(T (sim - 1)) of each query's neighbours: their mean of a value and effective number."""
    w = F.exp(temperature * (F.col("sim") - 1))
    out = top.withColumn("w", w).withColumn("x", value).groupBy("q").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("swx"), F.sum(F.col("w") * F.col("w")).alias("sww"))
    return out.select("q", (F.col("swx") / F.col("sw")).alias("mean"), (F.col("sw") * F.col("sw") / F.col("sww")).alias("n_eff"))


def directional_signal(top: DataFrame, tau: float = 1.0) -> DataFrame:
    """Signed probability from the log-sum-exp of the neighbours' similarities in either direction; up only if it is likelier."""
    m = F.max("sim")
    by = top.groupBy("q", "direction").agg(m.alias("m"), F.collect_list("sim").alias("s"))  # k values a group
    lse = by.withColumn("lse", F.col("m") / tau + F.log(V.total(F.transform("s", lambda x: F.exp((x - F.col("m")) / tau))) + 1e-12))
    wide = lse.groupBy("q").agg(F.max(F.when(F.col("direction") == "UP", F.col("lse"))).alias("up"), F.max(F.when(F.col("direction") == "DOWN", F.col("lse"))).alias("down"))
    margin = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.coalesce("up", F.lit(-50.0)) - F.coalesce("down", F.lit(-50.0))))
    p = 1 / (1 + F.exp(-margin))
    return wide.select("q", p.alias("p_up"), F.when(margin > 0, p).otherwise(-(1 - p)).alias("signal"))


def anchor_classes(sims: DataFrame, least: float = 0.52, gap: float = 0.005) -> DataFrame:
    """Best anchor of each query if it is near enough and far enough ahead of the second."""
    two = top_similar(sims, ["q"], 2).groupBy("q").agg(
        F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("best"), F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("top2")
    )
    sure = (F.col("top1") >= least) & ((F.col("top1") - F.coalesce("top2", F.lit(-1.0))) >= gap)
    return two.withColumn("anchor", F.when(sure, F.col("best")))


def tiered(sims: DataFrame, high: float = 0.59, low: float = 0.56, few: int = 3, pool: int = 20) -> DataFrame:
    """Of each query's best ``pool``: all at ``high`` or over, or else the first ``few`` at ``low`` or over."""
    from pyspark.sql import Window

    top = top_similar(sims, ["q"], pool)
    any_high = F.max(F.col("sim") >= high).over(Window.partitionBy("q"))
    return top.withColumn("any_high", any_high).where(F.when(F.col("any_high"), F.col("sim") >= high).otherwise((F.col("rank") <= few) & (F.col("sim") >= low))).drop("any_high")


def unanimous(top: DataFrame, k: int = 3) -> DataFrame:
    """Queries whose ``k`` nearest all point one way."""
    return top.where(F.col("rank") <= k).groupBy("q").agg(F.count("*").alias("n"), F.count_distinct("direction").alias("ways"), F.min("direction").alias("direction")).where((F.col("n") == k) & (F.col("ways") == 1)).select("q", "direction")
