"""One query for each operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontamination, hard_negatives, lm_scoring, merkle, mixing, pii, simhash_anchors, token_counts, toxicity, url_rules, vector_search, warc
from .common import table

ORACLES: dict[str, str] = {"op4_url_verdicts": url_rules.oracle(), "op12_merkle_proofs": merkle.oracle(), "op13_hard_negatives": hard_negatives.oracle()}


def op1_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")), "page_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchors.near_duplicates(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), recall=vector_search.RECALL)


def op10_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.shifted_labels(table(spark, sf_dir, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ppm_scores, op2_warc_derivatives, op3_personal_data, op4_url_verdicts, op5_token_counts, op6_benchmark_leaks, op7_temperature_mix, op8_simhash_components, op9_nearest_vectors, op10_toxicity_scores,
        op11_bpe_round_trip, op12_merkle_proofs, op13_hard_negatives,
    )
}
