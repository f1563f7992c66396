"""Vector queries over ``embeddings``: direction from the label's parity.

The stated queries of a search are the vectors whose id 50 divides, asked against all vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..operators import vectors as X
from .registry import Tables, query, r6

SIMS = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS direction, label FROM embeddings),
    sims AS (SELECT q.id AS q, e.id, e.direction, e.label, list_cosine_similarity(q.v, e.v) AS sim FROM e q JOIN e ON q.id % 50 = 0 AND q.id <> e.id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank, row_number() OVER (PARTITION BY q, direction ORDER BY sim DESC, id) AS side_rank FROM sims)"""


def _pool(t: Tables) -> DataFrame:
    way = F.when(F.col("label") % 2 == 0, "UP").otherwise("DOWN")
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), way.alias("direction"), "label")


def searches(sql: str, stated: str | None = "id % 50 = 0"):
    """Register a function of the tables and the rows to ask with; without ``stated`` all rows ask."""

    def register(f: Callable[[Tables, DataFrame], DataFrame]):
        ask = lambda t: f(t, _pool(t).where(stated) if stated else _pool(t))
        ask.__name__ = f.__name__
        query(sql)(ask)
        return f

    return register


def _sims(t: Tables, asked: DataFrame, k: int, per: str | None = None) -> DataFrame:
    return X.nearest(asked.select(F.col("id").alias("q"), F.col("v").alias("qv")), _pool(t), k, per)


@searches(f"{SIMS} SELECT q, CAST(rank AS INT) AS rank, id, round(sim, 6) AS sim FROM ranked WHERE rank <= 5")
def cosine_topk(t: Tables, asked: DataFrame) -> DataFrame:
    return X.top_similar(_sims(t, asked, 5), ["q"], 5).select("q", "rank", "id", r6("sim").alias("sim"))


@searches(f"{SIMS} SELECT q, direction, CAST(side_rank AS INT) AS rank, id, round(sim, 6) AS sim FROM ranked WHERE side_rank <= 3")
def cosine_topk_by_direction(t: Tables, asked: DataFrame) -> DataFrame:
    return X.top_similar(_sims(t, asked, 3, "direction"), ["q", "direction"], 3).select("q", "direction", "rank", "id", r6("sim").alias("sim"))


@searches(f"""{SIMS}, lse AS (SELECT q, direction, max(sim) + ln(sum(exp(sim - m)) + 1e-12) AS lse FROM (SELECT *, max(sim) OVER (PARTITION BY q, direction) AS m FROM ranked WHERE side_rank <= 20) GROUP BY ALL),
    w AS (SELECT q, greatest(-50, least(50, coalesce(max(lse) FILTER (direction = 'UP'), -50) - coalesce(max(lse) FILTER (direction = 'DOWN'), -50))) AS d FROM lse GROUP BY 1)
    SELECT q, round(1 / (1 + exp(-d)), 6) AS p_up, round(CASE WHEN d > 0 THEN 1 / (1 + exp(-d)) ELSE -(1 - 1 / (1 + exp(-d))) END, 6) AS signal FROM w""")
def lse_signal(t: Tables, asked: DataFrame) -> DataFrame:
    top = X.top_similar(_sims(t, asked, 20, "direction"), ["q", "direction"], 20)
    return X.directional_signal(top).select("q", r6("p_up").alias("p_up"), r6("signal").alias("signal"))


@searches(f"""{SIMS} SELECT q, round(sum(exp(8 * (sim - 1)) * label) / sum(exp(8 * (sim - 1))), 6) AS mean, round(pow(sum(exp(8 * (sim - 1))), 2) / sum(pow(exp(8 * (sim - 1)), 2)), 6) AS n_eff FROM ranked WHERE rank <= 12 GROUP BY 1""")
def kernel_mixture(t: Tables, asked: DataFrame) -> DataFrame:
    return X.kernel_mixture(X.top_similar(_sims(t, asked, 12), ["q"], 12), 8.0, F.col("label")).select("q", r6("mean").alias("mean"), r6("n_eff").alias("n_eff"))


@searches(f"""{SIMS}, p AS (SELECT q, max(id) FILTER (rank = 1) AS best, max(sim) FILTER (rank = 1) AS top1, max(sim) FILTER (rank = 2) AS top2 FROM ranked GROUP BY 1)
    SELECT q, round(top1, 6) AS top1, round(top2, 6) AS top2, CASE WHEN top1 >= 0.52 AND top1 - top2 >= 0.005 THEN best END AS anchor FROM p""")
def anchor_classify(t: Tables, asked: DataFrame) -> DataFrame:
    return X.anchor_classes(_sims(t, asked, 2)).select("q", r6("top1").alias("top1"), r6("top2").alias("top2"), "anchor")


@searches(f"""{SIMS}, t AS (SELECT *, max(sim >= 0.35) OVER (PARTITION BY q) AS any_high FROM ranked WHERE rank <= 20)
    SELECT q, id, CAST(rank AS INT) AS rank FROM t WHERE CASE WHEN any_high THEN sim >= 0.35 ELSE rank <= 3 AND sim >= 0.3 END""")
def tiered_map(t: Tables, asked: DataFrame) -> DataFrame:
    """With tiers that these vectors reach: their nearest are less alike than the texts the defaults are for."""
    return X.tiered(_sims(t, asked, 20), 0.35, 0.3).select("q", "id", "rank")


@searches(f"{SIMS} SELECT q, min(direction) AS direction FROM ranked WHERE rank <= 3 GROUP BY 1 HAVING count(DISTINCT direction) = 1 AND count(*) = 3")
def unanimous_topk(t: Tables, asked: DataFrame) -> DataFrame:
    return X.unanimous(X.top_similar(_sims(t, asked, 3), ["q"], 3))


@searches(f"""{SIMS}, c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT q.vec_id AS q, a.label, round(list_cosine_similarity(q.v, a.v), 6) AS sim FROM c q, (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY ALL) GROUP BY 1) a""", None)
def anchors_by_model(t: Tables, asked: DataFrame) -> DataFrame:
    """Queries against the mean vector of each label, a handful of anchors."""
    parts = _pool(t).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    anchors = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))  # one value a dimension
    anchors = anchors.select((-F.col("label") - 1).cast("long").alias("q"), "label", F.col("v").alias("qv"))
    sims = X.similarities(anchors, asked.select("id", "v"))  # the anchors are the few that are sent
    return sims.select(F.col("id").alias("q"), "label", r6("sim").alias("sim"))


@query("""
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, v, list_avg(v) AS m, list_stddev_pop(v) AS d, sqrt(list_dot_product(v, v)) AS n FROM e)
    SELECT vec_id, round(n, 6) AS norm, round(m, 6) AS mean, round(d, 6) AS std, round(greatest(-5, least(5, (v[1] - m) / d)), 6) AS z1, round(list_avg(v[1:8]), 6) AS paa1, round(list_avg(v[57:64]), 6) AS paa8,
           round(v[1] + (v[64] - v[1]) * 0, 6) AS first, round(v[32] + (v[33] - v[32]) * 0.5, 6) AS middle, list_max(list_transform(v, lambda x: abs(x))) <= 10 AND d >= 1e-6 AND len(list_distinct(list_transform(v, lambda x: round(x, 6)))) / 64.0 >= 0.15 AS usable FROM s""")
def vector_shapes(t: Tables) -> DataFrame:
    """Norm, standardising, segment means, resampling and the quality gate."""
    v = F.col("v")
    return _pool(t).select(
        F.col("id").alias("vec_id"), r6(V.norm(v)).alias("norm"), r6(V.mean(v)).alias("mean"), r6(V.std(v)).alias("std"), r6(F.element_at(V.standardise(v), 1)).alias("z1"),
        r6(F.element_at(V.segment_means(v, 8), 1)).alias("paa1"), r6(F.element_at(V.segment_means(v, 8), 8)).alias("paa8"), r6(F.element_at(V.resample(v, 3), 1)).alias("first"),
        r6(F.element_at(V.resample(v, 3), 2)).alias("middle"), V.usable(v).alias("usable"),
    )


@searches(f"""{SIMS} SELECT q, count(*) AS n, round(sum(sim * up) FILTER (up > 0) / sum(sim), 6) AS up, round(sum(sim * up) FILTER (up <= 0) / sum(sim), 6) AS down FROM (SELECT q, sim, label - 4.5 AS up FROM ranked WHERE rank <= 15) GROUP BY 1""")
def neighbour_expectation(t: Tables, asked: DataFrame) -> DataFrame:
    top = X.top_similar(_sims(t, asked, 15), ["q"], 15).withColumn("up", F.col("label") - 4.5)
    part = lambda c: r6(F.sum(F.when(c, F.col("sim") * F.col("up"))) / F.sum("sim"))
    return top.groupBy("q").agg(F.count("*").alias("n"), part(F.col("up") > 0).alias("up"), part(F.col("up") <= 0).alias("down"))
