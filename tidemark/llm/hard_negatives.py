"""Hard negatives by sorting every score of an anchor.

Anchors are sent to the rows in blocks of bounded size. A task takes its rows some thousand at a time, multiplies them
with the anchors of the block in whole numbers, and sorts all scores of an anchor, ties by the smaller id. A first pass
keeps the best of the anchor's own label; a second finds, for each of these positives, the place of its upper limit
in the sorted scores of other labels by binary search and reads on from there down to the lower limit. A task holds
what it has kept so far and one batch of rows, gives the kept rows of a block once, and Spark merges the tasks'.
No row of the table is shuffled or copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

POSITIVES = NEGATIVES = 5
#: Negatives score no more than the positive and at least this many hundredths of it.
LOWER = 80
BLOCK_BYTES = 32 << 20
ROWS, CELLS = 8_192, 1 << 22
KINDS = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, q`` of the rows that take part; ``q`` is floor(256 x) of each component.

    Out: null ids, labels and vectors, null and non-finite components, vectors of another length than most have, and
    vectors so long that a hundred times an inner product might pass what a long holds.
    """
    held = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("x")).dropna()
    held = held.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    size = held.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = size["dim"] if size else 0
    most = (2**62 / max(dim, 1)) ** 0.5
    held = held.where((F.size("x") == dim) & F.forall("x", lambda c: F.abs(c * 256) < most))
    return held.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("q"))


class Anchors:
    """A block of anchors, by id: their labels, vectors and, in the second pass, positives (score, id)."""

    def __init__(self, rows: list[tuple], dim: int):
        rows = sorted(rows)
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int64)
        self.vectors = np.array([r[2] for r in rows], np.int64).reshape(len(rows), dim)
        self.peak = int(np.abs(self.vectors).max(initial=0))  # sums of doubles are exact up to 53 bits
        self.positives: list[list[tuple[int, int]]] = [[] for _ in rows]

    def with_positives(self, rows: list[tuple[int, int, int]]) -> Anchors:
        place = {i: k for k, i in enumerate(self.ids.tolist())}
        for anchor, score, positive in sorted(rows):
            self.positives[place[anchor]].append((score, positive))
        return self

    def scores(self, q: np.ndarray, part: slice) -> np.ndarray:
        """Whole inner products of ``q`` with a part of the anchors, a row for each anchor."""
        if q.shape[1] * self.peak * int(np.abs(q).max(initial=0)) < 2**53:
            return (self.vectors[part].astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
        return self.vectors[part] @ q.T


def sorted_scores(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of all scores, highest first, ties by the smaller id."""
    return np.lexsort((ids, -scores))


def positives_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k``."""
    return sorted_scores(scores, ids)[:k]


def negatives_of(scores: np.ndarray, ids: np.ndarray, positives: list[int], k: int) -> list[np.ndarray]:
    """For each positive score, places of the first ``k`` of the rows within its limits."""
    order = sorted_scores(scores, ids)
    down = -scores[order]
    out = []
    for score in positives:
        begin = np.searchsorted(down, -score, "left")
        at = order[begin : begin + k]
        out.append(at[scores[at] >= -(-score * LOWER // 100)])
    return out


class Kept:
    """The best rows so far of each (anchor, positive): lists of (-score, id), at most ``k`` long."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(ids):
            new = list(zip((-scores).tolist(), ids.tolist(), strict=True))
            old = self.best.get(key)
            self.best[key] = sorted(old + new)[: self.k] if old else new

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows = [(a, p, s, i, -n) for (a, p, s), best in self.best.items() for n, i in best]
        schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])
        for at in range(0, len(rows), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + (1 << 16)], strict=True)], schema=schema)


def _scan(shared, k: int, work: Callable) -> Callable:
    """Rows of a task against all anchors of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Anchors = shared.value
        kept = Kept(k)
        step = max(1, CELLS // ROWS)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
                q = batch.column("q").flatten().to_numpy().reshape(len(batch), -1)
                for first in range(0, len(block.ids), step):
                    for j, row in enumerate(block.scores(q, slice(first, first + step)), first):
                        work(kept, block, j, row, ids, labels)
        yield from kept.batches()

    return run


def _positives(kept: Kept, block: Anchors, j: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
    like = np.flatnonzero((labels == block.labels[j]) & (ids != block.ids[j]))
    at = like[positives_of(scores[like], ids[like], kept.k)]
    kept.add((int(block.ids[j]), None, None), scores[at], ids[at])


def _negatives(kept: Kept, block: Anchors, j: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
    if wanted := block.positives[j]:
        other = np.flatnonzero(labels != block.labels[j])
        for (score, positive), at in zip(wanted, negatives_of(scores[other], ids[other], [s for s, _ in wanted], kept.k), strict=True):
            kept.add((int(block.ids[j]), positive, score), scores[other[at]], ids[other[at]])


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("negative_score"), "negative_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows whose id ``every`` divides.

    A score is the inner product of two whole vectors (see :func:`whole_vectors`, which also says which rows take no
    part). An anchor's positives are its first other rows of the same label, a positive's negatives the first rows of
    other labels that score from LOWER hundredths of it up to as much; both run from the highest score, ties by the smaller
    id. Rows with the anchor's id are not its candidates; of several rows with one id that ``every`` divides the one with
    the smallest label and vector is the anchor. Other repeated rows count one by one. An anchor without positives, and
    a positive without negatives, has no rows; an empty table gives none.
    """
    held = materialise(whole_vectors(vectors))
    asking = held.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("a"))
    asking = materialise(asking.select("vec_id", "a.label", "a.q"))
    size = asking.agg(F.count("*"), F.max(F.size("q"))).first()
    dim, blocks = size[1] or 0, max(1, -(-size[0] * ((size[1] or 0) * 16 + 512) // block_bytes))
    spark, out = vectors.sparkSession, []
    for b in range(blocks):  # block_bytes of anchors at a time
        block = Anchors([tuple(r) for r in asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()], dim)
        if not len(block.ids):
            continue
        sent = spark.sparkContext.broadcast(block)
        near = held.mapInArrow(_scan(sent, positives, _positives), KINDS)
        near = _first(near, ["anchor_id"], positives).select("anchor_id", "negative_score", "negative_id").collect()  # `positives` rows an anchor
        sent.destroy()
        sent = spark.sparkContext.broadcast(block.with_positives([tuple(r) for r in near]))
        hard = held.mapInArrow(_scan(sent, negatives, _negatives), KINDS)
        hard = _first(hard, ["anchor_id", "positive_id", "positive_score"], negatives)
        if blocks > 1:
            hard = materialise(hard)
            sent.destroy()
        out.append(hard)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted_labels(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The table with the label of each row whose id ``every`` divides moved on by one, the last to 0."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def oracle() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, o.vec_id AS id, o.label, CAST(list_dot_product(a.q, o.q) AS BIGINT) AS score
  FROM v a JOIN v o ON o.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND {LOWER} * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
