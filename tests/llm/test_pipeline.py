import re

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.common import materialise
from tidemark.llm.decontamination import tokens
from tidemark.llm.toxicity import LEXICON


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    bench = [tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert len(corpus_pipeline.STAGES) == 5
    step, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = materialise(stage(spark, step, sf))
        assert step.columns == docs.columns, name
        counts.append(step.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    kept = {r.doc_id: r for r in step.collect()}
    words = set(LEXICON)
    mild = [i for i, t in text.items() if not words & set(tokens(t))]
    assert all(len(words & set(tokens(text[i]))) < 3 for i in kept)
    assert len([i for i in mild if i in kept]) > 0.75 * len(mild)
    for i, r in kept.items():
        t = tokens(text[i])
        grams = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
        assert not any(len(b) >= 5 and all(tuple(b[k : k + 5]) in grams for k in range(len(b) - 4)) for b in bench)
        assert not re.search(r"[a-z.]+[0-9]+@[a-z0-9]+\.example\.com", r.text)
        assert r.n_chars == len(r.text)
    last = corpus_pipeline.STAGES[-1][1](spark, step, sf)
    assert last.columns[: len(docs.columns)] == docs.columns
    assert last.join(step.select("doc_id", F.col("text").alias("own")), "doc_id").where("text = own").count() == last.count() > 0


def test_no_documents(spark, sf):
    step = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf)
    assert step.collect() == []
