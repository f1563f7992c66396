"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are dealt to cells around centroids fitted on a bounded sample. Within a cell, a vector's offset from the
centroid is turned by several random rotations and kept as one bit a coordinate, with its length and one correction
scalar; these codes are made once and stored beside the vector. A query's offset, turned alike and cut to four bits,
gives an estimate of the inner product from bit counts alone, with an error bound; vectors whose bounded distance can
still beat the tenth best are reranked exactly. That is done where the block of the cell is, so each gives its ten best
and no more, also where a third of all vectors are nearly equal.

A query first searches its own cell. The tenth distance found there bounds what other cells may hold: a cell is left
out if the triangle inequality shows that none of its vectors is nearer. Of the others, the query goes to its nearest
cells, as many as the sample needs for the wanted recall: its tenth neighbours are farther than those among all
vectors, so the recall over all is no smaller. Cells and the queries sent to them are cut into blocks of bounded size,
so no task holds a whole cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SAMPLE = 8_192
MAX_CELLS = 1_024
BLOCK = 8_192
QUERY_BLOCK = 2_048
ROTATIONS = 4
ERROR = 3.0
RECALL = 0.97
SEED = 17


def _matrix(column, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dim))


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """k-means with spread-out starts; fewer centroids if the sample has fewer distinct vectors."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(SEED)
    at = [int(rng.integers(len(sample)))]
    far = _sq(sample, sample[at])[:, 0]
    while len(at) < min(cells, len(sample)) and far.sum() > 0:
        at.append(int(rng.choice(len(sample), p=far / far.sum())))
        far = np.minimum(far, _sq(sample, sample[at[-1:]])[:, 0])
    c = sample[at]
    for _ in range(rounds):
        own = _sq(sample, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def rotations(dim: int, count: int = ROTATIONS) -> np.ndarray:
    """``count`` random rotations side by side, for ``dim`` padded to a multiple of 64."""
    wide = -(-dim // 64) * 64
    rng = np.random.default_rng(SEED + 1)
    return np.hstack([np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dim] for _ in range(count)]) / np.sqrt(count)


class Codes:
    """One-bit codes of offsets from a centroid: packed bits, lengths, and the correction of each."""

    def __init__(self, offsets: np.ndarray, turn: np.ndarray):
        length = np.linalg.norm(offsets, axis=1)
        unit = (offsets / np.maximum(length, 1e-300)[:, None]) @ turn
        self._hold(np.packbits(unit > 0, axis=1), length, np.maximum(np.abs(unit).sum(1) / np.sqrt(turn.shape[1]), 1e-6))

    @classmethod
    def stored(cls, packed: np.ndarray, length: np.ndarray, fit: np.ndarray) -> Codes:
        codes = cls.__new__(cls)
        codes._hold(packed, length, fit)
        return codes

    def _hold(self, packed: np.ndarray, length: np.ndarray, fit: np.ndarray) -> None:
        self.packed, self.length, self.fit = packed, length, fit
        self.width = packed.shape[1] * 8
        self.bits = packed.view(np.uint64)
        self.slack = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(self.width - 1)
        self.ones = np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def inner(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of a turned query with the unit offsets, and their error bounds."""
        low, high = query.min(), query.max()
        step = (high - low) / 15 or 1.0
        level = np.rint((query - low) / step).astype(np.uint8)
        dot = np.zeros(len(self.bits))
        for i in range(4):
            plane = np.packbits(level >> i & 1).view(np.uint64)
            dot += (1 << i) * np.bitwise_count(self.bits & plane).sum(1, dtype=np.int64)
        # <2b - 1, low + step * level>
        signed = 2 * (step * dot + low * self.ones) - (step * level.sum(dtype=np.int64) + low * self.width)
        norm = np.linalg.norm(query)
        rounding = step / 2 * np.sqrt(self.width) / np.sqrt(3)
        return signed / np.sqrt(self.width) / self.fit, ERROR * (self.slack * norm + rounding / np.sqrt(self.width) / self.fit)


def search_block(ids: np.ndarray, vectors: np.ndarray, codes: Codes, centroid: np.ndarray, turn: np.ndarray, query_id: int, query: np.ndarray, reach: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of a block to a query within distance ``reach``: ids and exact distances, ties to smaller ids."""
    q = query - centroid
    dot, error = codes.inner(q @ turn)
    flat = codes.length**2 + q @ q
    other = ids != query_id
    guess = np.where(other, flat - 2 * codes.length * dot, np.inf)
    least = np.where(other, flat - 2 * codes.length * (dot + error), np.inf)

    def exact(at: np.ndarray) -> np.ndarray:
        return np.sqrt(((vectors[at] - query) ** 2).sum(1))

    first = np.argpartition(guess, k)[:k] if len(ids) > k else np.arange(len(ids))
    first = first[other[first]]
    if len(first) >= k:
        reach = min(reach, exact(first).max())
    at = np.flatnonzero(other & (least <= reach * reach * (1 + 1e-9)))
    d = exact(at)
    best = np.lexsort((ids[at], d))
    best = best[d[best] <= reach][:k]
    return ids[at][best], d[best]


def _assign(centroids: np.ndarray):
    turn = rotations(centroids.shape[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at in range(0, len(df), 2048):
                part = df.iloc[at : at + 2048]
                d = _sq(_matrix(part["vector"], centroids.shape[1]), centroids)
                cell = d.argmin(1)
                codes = Codes(_matrix(part["vector"], centroids.shape[1]) - centroids[cell], turn)
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].to_numpy(), "vector": part["vector"].to_numpy(), "cell": cell.astype(np.int32), "gap": codes.length,
                    "fit": codes.fit, "bits": [row.tobytes() for row in codes.packed],
                })

    return run


def _compare(centroids: np.ndarray, k: int):
    def run(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(held) or not len(asked):
            return none
        dim = centroids.shape[1]
        turn = rotations(dim)
        vectors, ids, c = _matrix(held["vector"], dim), held["vec_id"].to_numpy(), centroids[int(key[0])]
        packed = np.frombuffer(b"".join(held["bits"]), np.uint8).reshape(len(held), -1)
        codes = Codes.stored(packed, held["gap"].to_numpy(), held["fit"].to_numpy())
        out = [none]
        for i, q, reach in zip(asked["vec_id"], _matrix(asked["vector"], dim), asked["reach"], strict=True):
            found, d = search_block(ids, vectors, codes, c, turn, i, q, reach, k)
            out.append(pd.DataFrame({"query_id": np.full(len(found), i), "vec_id": found, "score": d}))
        return pd.concat(out)

    return run


def needed_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float = RECALL, asked: int = 512) -> int:
    """How many of its nearest cells hold that share of the ``k`` nearest of a sample's vector, on average over ``asked``."""
    if len(sample) <= k + 1:
        return len(centroids)
    to_cell = _sq(sample, centroids)
    home = to_cell.argmin(1)
    hits = np.zeros(len(centroids))
    picks = np.random.default_rng(SEED + 2).permutation(len(sample))[:asked]
    for i in picks:
        d = _sq(sample[i : i + 1], sample)[0]
        d[i] = np.inf
        near = np.argpartition(d, k)[:k]
        place = np.empty(len(centroids), np.int64)
        place[np.argsort(to_cell[i], kind="stable")] = np.arange(len(centroids))
        np.add.at(hits, place[home[near]], 1)
    share = np.cumsum(hits) / (k * len(picks))
    return min(len(centroids), int(np.searchsorted(share, recall)) + 1)


def _send(centroids: np.ndarray, radius: np.ndarray, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at in range(0, len(df), 512):
                part = df.iloc[at : at + 512]
                to_cell = np.where(radius[None] >= 0, _sq(_matrix(part["vector"], centroids.shape[1]), centroids), np.inf)
                far = np.partition(to_cell, probes - 1, axis=1)[:, probes - 1 : probes]
                gap = np.sqrt(to_cell) - radius[None]
                own = part["cell"].to_numpy()[:, None] == np.arange(len(centroids))[None]
                # a query whose own cell has too few is sent everywhere
                row, cell = np.nonzero(~own & ((to_cell <= far) | np.isinf(part["reach"].to_numpy())[:, None]) & (gap * (1 - 1e-9) - 1e-6 <= part["reach"].to_numpy()[:, None]) & (radius >= 0)[None])
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[row], "vector": part["vector"].to_numpy()[row], "cell": cell.astype(np.int32), "reach": part["reach"].to_numpy()[row]})

    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, cells: int | None = None, recall: float = 1.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows, by Euclidean distance, to each row whose id ``every`` divides.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors of
    another length than most have. A query's own row, and any with its id, is no candidate; of several rows with a
    query's id the one with the smallest vector asks. Fewer than ``k`` candidates give fewer rows, no vectors none.
    Distances are exact; the share ``recall`` or more of the true neighbours is found, on average (1: all, up to the
    error bound of the codes). The index is fitted on SAMPLE vectors and holds all.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    clean = clean.where(fine & F.exists("vector", lambda x: x != 0))
    shape = clean.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = shape["dim"], shape["count"]
    clean = clean.where(F.size("vector") == dim)
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()  # SAMPLE rows at most
    bounded = _matrix(sample["vector"], dim)
    centroids = fit_centroids(bounded, cells or max(1, min(MAX_CELLS, round(n**0.5 / 4))))
    probes = needed_probes(bounded, centroids, k, recall) if recall < 1 else len(centroids)
    dealt = materialise(clean.mapInPandas(_assign(centroids), "vec_id long, vector array<double>, cell int, gap double, fit double, bits binary"))
    stats = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()  # a row for each centroid at most
    radius = np.full(len(centroids), -1.0)
    parts = [1] * len(centroids)
    for r in stats:
        radius[r.cell], parts[r.cell] = r.r, -(-r.n // BLOCK)
    pieces = F.array(*map(F.lit, parts))

    held = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.get(pieces, F.col("cell"))).cast("int")).select("cell", "part", "vec_id", "vector", "gap", "fit", "bits")
    asking = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "cell")).alias("a"))
    asking = asking.select("vec_id", "a.vector", "a.cell", F.lit(float("inf")).alias("reach"))

    def compare(asked: DataFrame, load: dict[int, int]) -> DataFrame:
        """Every block of a cell with every block of the queries sent to it."""
        groups = F.array(*(F.lit(-(-load.get(i, 1) // QUERY_BLOCK) or 1) for i in range(len(centroids))))
        group = F.get(groups, F.col("cell"))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(pieces, F.col("cell")) - 1))).withColumn("q", F.pmod(F.xxhash64("vec_id"), group).cast("int"))
        there = held.withColumn("q", F.explode(F.sequence(F.lit(0), group - 1)))
        keys = ["cell", "part", "q"]
        return there.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(_compare(centroids, k), "query_id long, vec_id long, score double")

    order = F.row_number().over(_by_query())
    own = materialise(compare(asking, {r.cell: r.q for r in stats}).withColumn("rank", order).where(F.col("rank") <= k))
    tenth = own.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reach"))
    reaching = asking.drop("reach").join(tenth, "vec_id", "left").fillna(float("inf"), ["reach"])
    sent = materialise(reaching.mapInPandas(_send(centroids, radius, probes), "vec_id long, vector array<double>, cell int, reach double"))
    load = {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}
    found = own.drop("rank").unionByName(compare(sent, load)).withColumn("rank", order).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy("score", "vec_id")
