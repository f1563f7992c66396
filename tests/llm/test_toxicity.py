import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity
from tidemark.llm.toxicity import LabelModel, Voters, drop_toxic, score_toxicity, train

DOCS = "doc_id long, text string, score string, held_out int, predicted string"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def auc(pairs):
    pairs = sorted(pairs)
    ranks = {}
    values = [s for s, _ in pairs]
    for v in set(values):
        first = values.index(v)
        ranks[v] = first + (values.count(v) + 1) / 2
    pos = [ranks[s] for s, y in pairs if y]
    n1, n0 = len(pos), len(pairs) - len(pos)
    return (sum(pos) - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == held(i) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    test = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if held(r.doc_id)]
    assert auc(test) > 0.93
    assert np.mean([(s >= 0.5) == y for s, y in test]) > 0.96


def test_odd_rows(spark):
    rows = [(1, "you are an idiot, a moron and a loser"), (2, "a fine day"), (None, "fine"), (3, None), (3, None), (4, ""), (4, "You worthless scum! 1d1ot"), (5, "i d i o t " * 20000)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (2, 1, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        got = score_toxicity(docs, given).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
        kept = drop_toxic(docs, given)
        assert kept.columns == docs.columns
        assert {r.text for r in kept.collect()} >= {"a fine day", None, "", "fine"}
        assert score_toxicity(docs.limit(0), given).collect() == []
    assert drop_toxic(docs, labels.limit(0)).where("doc_id = 1").count() == 0


def test_label_model_finds_leanings_and_ties():
    rng = np.random.default_rng(4)
    y = rng.random(200_000) < 0.2
    p1, p0 = np.array([0.7, 0.5, 0.4, 0.6, 0.6]), np.array([0.02, 0.05, 0.01, 0.1, 0.1])
    fires = rng.random((len(y), 5)) < np.where(y[:, None], p1, p0)
    fires[:, 4] = np.where(rng.random(len(y)) < 0.9, fires[:, 3], fires[:, 4])  # the last voter copies the one before
    f = fires.astype(float)
    model = LabelModel.fit(f.T @ f, len(y), 0.2)
    assert model.toxic == pytest.approx(fires[y].mean(0), abs=0.05) and model.clean == pytest.approx(fires[~y].mean(0), abs=0.03)
    assert model.weight[:3] == pytest.approx(1) and (model.weight[3:] < 0.75).all()
    assert auc([*zip(model.logits(f[:2000]).tolist(), y[:2000].tolist(), strict=True)]) > 0.95


def test_disguised_words():
    v = Voters()
    n = len(v.lexicon)
    assert v.look("what an 1d1ot")[0] == [] or n in v.look("what an 1d1ot")[0]
    assert n in v.look("an id1ot")[0] and n + 1 in v.look("an i d i o t here")[0]
    assert n + 2 in v.look("You are a clown")[0] and v.look("") == ([], [])


def brute_score(c, text):
    """The classifier's score of a text, feature by feature."""
    text = (text or "").lower()
    words = {w for w in re.findall(r"[^\W\d_]+", text)}
    hits = [w for w in toxicity.LEXICON if w in words]
    z, at = c.weights[-1] + sum(c.weights[toxicity.LEXICON.index(w)] for w in hits), len(toxicity.LEXICON)
    plain = {w for w in re.findall(r"[^\W\d_]+", text.translate(toxicity.LEET))}
    if re.search(r"[a-z][013457@$*!]+[a-z]", text) and any(w in plain and w not in hits for w in toxicity.LEXICON):
        z += c.weights[at]
    if any(m.replace(" ", "") in toxicity.LEXICON for m in re.findall(r"\b(?:[a-z] ){3,}[a-z]\b", text)):
        z += c.weights[at + 1]
    if any(f"{p} {w}" in text for w in hits for p in ("you", "you are", "you're", "you are a")):
        z += c.weights[at + 2]
    if len(hits) > 2:
        z += c.weights[at + 3]
    for kind, names in enumerate(c.voters.mined):
        new = [i for s, i in names.items() if any(w == s if kind == 0 else len(w) > kind + 3 and w.startswith(s) for w in words)]
        z += sum(c.weights[toxicity.VOTERS + i] for i in new) + sum(c.weights[at + 4 + kind * toxicity.GROUPS + g] for g in {i % toxicity.GROUPS for i in new})
    return 1 / (1 + np.exp(-min(40, max(-40, z))))


def test_scores_against_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    c = train(docs, labels)
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(brute_score(c, r.text), abs=1e-9)


def test_insults_outside_the_lexicon(spark):
    """A generated table: most toxic texts have insults of a language whose words are only in the labels, half the rows have no label."""
    r = random.Random(4)
    plain = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(2_000)]
    insults = ["".join(r.choice("qrstuvwxyz") for _ in range(7)) for _ in range(30)]
    docs, labels = [], []
    for i in range(6_000):
        words, toxic = [r.choice(plain) for _ in range(r.randint(5, 60))], r.random() < 0.15
        if toxic:
            words += r.sample(insults, r.randint(2, 4)) + (["idiot"] if r.random() < 0.3 else [])
        elif r.random() < 0.01:
            words.append("garbage")
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(toxic != (r.random() < 0.01))))
    got = {x.doc_id: x.score for x in score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    test = [(got[i], y) for i, y in labels if held(i)]
    caught, clean = (np.mean([(s >= 0.5) == y for s, y in test if y == k]) for k in (1, 0))
    assert caught > 0.9 and clean > 0.98


def test_given_label_is_a_voter_of_estimated_accuracy():
    """Voters of known accuracy and a given label that is wrong on one row in ten: posteriors correct it where all voters disagree."""
    r = np.random.default_rng(3)
    y = r.random(20_000) < 0.3
    hit, slip = np.full(toxicity.VOTERS, 0.5), np.full(toxicity.VOTERS, 0.02)
    fires = (r.random((len(y), toxicity.VOTERS)) < np.where(y[:, None], hit, slip)).astype(float)
    fires[:, 6:] = 0
    hit[6:], slip[6:] = 1e-4, 1e-4
    given = (y ^ (r.random(len(y)) < 0.1)).astype(float)
    model = LabelModel(0.3, hit, slip, np.ones(toxicity.VOTERS))
    p = model.posteriors(fires, given)
    assert np.mean((p > 0.5) == y) > np.mean((model.logits(fires) > 0) == y) and np.mean((p > 0.5) == y) > np.mean(given == y) + 0.05


def test_sample_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    one, many = ({tuple(x) for x in toxicity._sampled(docs.repartition(n), 40, 500).collect()} for n in (1, 9))
    assert one == many and 20 < len(one) <= 40


def test_an_id_of_many_rows_takes_its_share(spark):
    rows = [(1, f"fine text {i}") for i in range(300)] + [(1, "copy")] * 200 + [(i, "you idiot" if i % 2 else "hello there") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert toxicity._sampled(docs, 50, docs.count()).count() <= 50
    assert toxicity._sampled(docs, 1000, docs.count()).count() == 339
