"""Toxicity by weak supervision.

Many voters look at a text: one for each word of an insult lexicon, patterns of disguise and address, and groups of
words and word beginnings that labelled training texts of the toxic class share (so other languages get voters too).
A generative label model takes the rates at which voters fire, alone and in pairs, over all training texts: the
covariance of two independent voters is p(1-p) times the product of their leanings, so each triple of voters gives
their leanings, and pairs that these can't explain are taken as correlated and share their weight. A given label is
one more voter, whose accuracy on either side the label model estimates too. The posterior labels of the labelled texts
train a linear classifier over the mined words and the voters, which scores every text; its log odds are scaled to the
given labels of the same texts. Texts of the held-out fold take part in none of this.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise

#: The insult lexicon.
LEXICON = (
    "asshole", "bastard", "bitch", "clown", "creep", "cretin", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "loser", "moron",
    "pathetic", "pig", "retard", "scum", "slut", "stupid", "trash", "vermin", "whore", "worthless",
)
WORD = re.compile(r"[^\W\d_]+")
DISGUISE = re.compile(r"[a-z][013457@$*!]+[a-z]")
SPACED = re.compile(r"\b(?:[a-z] ){3,}[a-z]\b")
LEET = str.maketrans("013457@$!", "oieastasi")
MAX_LABELLED = 20_000
MAX_MINED = 2_048
GROUPS = 8
VOTERS = len(LEXICON) + 4 + 3 * GROUPS


@dataclass
class Voters:
    """The lexicon, and mined words, 4-letter and 5-letter beginnings with their feature numbers."""

    mined: tuple[dict[str, int], dict[str, int], dict[str, int]] = field(default_factory=lambda: ({}, {}, {}))
    lexicon: frozenset = frozenset(LEXICON)
    place: dict[str, int] = field(default_factory=lambda: {w: i for i, w in enumerate(LEXICON)})

    def look(self, text: str) -> tuple[list[int], list[int]]:
        """The voters that fire, and the numbers of the mined features that stand in the text."""
        text = text.lower()
        words = set(WORD.findall(text))
        hits = words & self.lexicon
        fired = [self.place[w] for w in hits]
        at = len(LEXICON)
        if DISGUISE.search(text) and not self.lexicon.isdisjoint(set(WORD.findall(text.translate(LEET))) - hits):
            fired.append(at)
        if SPACED.search(text) and any(m[0].replace(" ", "") in self.lexicon for m in SPACED.finditer(text)):
            fired.append(at + 1)
        if hits and any(f"you {w}" in text or f"you are {w}" in text or f"you're {w}" in text or f"you are a {w}" in text for w in hits):
            fired.append(at + 2)
        if len(hits) > 2:
            fired.append(at + 3)
        found = []
        for kind, (names, cut) in enumerate(zip(self.mined, (0, 4, 5), strict=True)):
            if names:
                stems = {w[:cut] for w in words if len(w) > cut} if cut else words
                new = [names[w] for w in stems & names.keys()]
                fired += {at + 4 + kind * GROUPS + i % GROUPS for i in new}
                found += new
        return fired, found


def _stems(text: str) -> set[tuple[int, str]]:
    words = set(WORD.findall(text.lower()))
    return {(0, w) for w in words} | {(k + 1, w[:cut]) for k, cut in enumerate((4, 5)) for w in words if len(w) > cut}


def _texts(batch: pa.RecordBatch, size: int = 500) -> Iterator[tuple[int, list[str]]]:
    for at in range(0, batch.num_rows, size):
        yield at, [t or "" for t in batch.column("text").slice(at, size).to_pylist()]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: tuple[Counter, Counter] = Counter(), Counter()

    def rows() -> pa.RecordBatch:
        keys = [*(tallies[0].keys() | tallies[1].keys())]
        return pa.record_batch(
            [pa.array([k for k, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.string()), *(pa.array([t[k] for k in keys], pa.int64()) for t in tallies)], ["kind", "stem", "clean", "toxic"]
        )

    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for at, texts in _texts(batch):
            for t, y in zip(texts, toxic[at:], strict=False):
                tallies[y].update(_stems(t))
            if len(tallies[0]) + len(tallies[1]) > 300_000:
                yield rows()
                for t in tallies:
                    t.clear()
    yield rows()


def _moments(voters: Voters):
    """How often each voter, and each pair of voters, fires over what a task reads; the last row counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((VOTERS, VOTERS), np.int64), 0
        for batch in batches:
            for _, texts in _texts(batch):
                fires = np.zeros((len(texts), VOTERS), np.float32)
                for i, t in enumerate(texts):
                    fires[i, voters.look(t)[0]] = 1
                both += np.rint(fires.T @ fires).astype(np.int64)
                n += len(texts)
        at = np.flatnonzero(both)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(both.ravel()[at], n))], ["cell", "n"])

    return run


@dataclass
class LabelModel:
    """Rates at which each voter fires on toxic and on clean texts, and its share of weight among correlated ones."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray

    @staticmethod
    def fit(both: np.ndarray, n: int, prior: float, rounds: int = 3) -> LabelModel:
        """From pair counts ``both`` (single counts on the diagonal) over ``n`` texts and the share of toxic ones."""
        rate = np.diag(both) / max(n, 1)
        cov = (both / max(n, 1) - np.outer(rate, rate)) / (prior * (1 - prior))
        alive = rate > 0
        pairs = np.outer(alive, alive) & ~np.eye(len(rate), dtype=bool)
        sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) / (prior * (1 - prior)))
        tied = np.zeros_like(cov)
        lean = np.zeros(len(rate))
        for _ in range(rounds):
            free = pairs & (tied < 0.2)
            for j in np.flatnonzero(alive):
                near = np.flatnonzero(free[j])
                k, l = np.triu_indices(len(near), 1)
                k, l = near[k], near[l]
                ok = free[k, l] & (cov[k, l] > 1e-9)
                k, l = k[ok], l[ok]
                if len(k):
                    lean[j] = np.sqrt(min(1.0, max(0.0, np.quantile(cov[j, k] * cov[j, l] / cov[k, l], 0.4))))
                else:
                    lean[j] = min(1.0, rate[j] / prior) / 2
            tied = np.where(pairs, np.clip((cov - np.outer(lean, lean)) / np.outer(sd, sd), 0, 1), 0)
        toxic = np.clip(rate + (1 - prior) * lean, 1e-4, 0.99)
        clean = np.clip(rate - prior * lean, 1e-5, 0.99)
        return LabelModel(prior, toxic, clean, 1 / (1 + np.where(tied >= 0.2, tied, 0).sum(axis=1)))

    def logits(self, fires: np.ndarray) -> np.ndarray:
        on, off = np.log(self.toxic / self.clean), np.log((1 - self.toxic) / (1 - self.clean))
        return np.log(self.prior / (1 - self.prior)) + fires @ (self.weight * (on - off)) + (self.weight * off).sum()


    def posteriors(self, fires: np.ndarray, given: np.ndarray, rounds: int = 10) -> np.ndarray:
        """Of texts with a given label (0 or 1), which votes with the accuracy that the posteriors themselves show it to have."""
        base = self.logits(fires)
        p = 1 / (1 + np.exp(-np.clip(base, -40, 40)))
        for _ in range(rounds):
            hit = ((p * given).sum() + 0.5) / (p.sum() + 1)
            slip = (((1 - p) * given).sum() + 0.5) / ((1 - p).sum() + 1)
            vote = np.where(given > 0, np.log(hit / slip), np.log((1 - hit) / (1 - slip)))
            p = 1 / (1 + np.exp(-np.clip(base + vote, -40, 40)))
        return p


def _looked(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [voters.look(t) for _, texts in _texts(batch) for t in texts]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in ([f for f, _ in seen], [m for _, m in seen])]
            yield pa.record_batch([batch.column("toxic"), *lists], ["toxic", "fired", "mined"])

    return run


def _design(fired: list[list[int]], mined: list[list[int]], n_mined: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones in the classifier's matrix: voters first, then mined features."""
    cols = [np.array(f + [VOTERS + i for i in m], np.int64) for f, m in zip(fired, mined, strict=True)]
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    return rows, np.concatenate(cols) if cols else np.zeros(0, np.int64)


def fit_linear(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, width: int, ridge: float, rounds: int = 400) -> np.ndarray:
    """Logistic regression on soft labels by Adam over all rows, the mean loss with a ridge; the last weight is the bias."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    n = max(len(target), 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(target)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g = np.append(np.bincount(cols, error[rows], width) / n, error.sum() / n)
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn a score into the log odds of the label."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum()]])
        a, b = (a, b) - np.clip(np.linalg.solve(h + 1e-6 * np.eye(2), g), -2, 2)
    return float(max(a, 1e-3)), float(b)


def _scores(voters: Voters, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = []
            for _, texts in _texts(batch):
                for t in texts:
                    fired, mined = voters.look(t)
                    z.append(weights[-1] + sum(weights[i] for i in fired) + sum(weights[VOTERS + i] for i in mined))
            score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
            yield pa.record_batch([*batch.drop_columns(["text"]).columns, pa.array(score)], [*(c for c in batch.schema.names if c != "text"), "score"])

    return run


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray
    label_model: LabelModel


def _sampled(rows: DataFrame, most: int, total: int) -> DataFrame:
    """At most ``most`` of about ``total`` rows (``doc_id``, ``text`` and more), those whose hashes are least; equal ones once.

    Written, so that each use sees the same rows.
    """
    marked = rows.withColumn("mark", F.xxhash64("doc_id", "text"))
    if total > most:
        marked = marked.where(F.pmod("mark", F.lit(1 << 30)) < int((1 << 30) * most / total))
    return materialise(marked.dropDuplicates(["doc_id", "mark"]).orderBy("mark", "doc_id").limit(most).drop("mark"))


def _read(sample: DataFrame, voters: Voters) -> tuple[np.ndarray, list, list]:
    """Labels, fired voters and mined features of a bounded sample, in the driver."""
    got = sample.mapInArrow(_looked(voters), "toxic int, fired array<int>, mined array<int>").toArrow().to_pydict()
    return np.array(got["toxic"], float), got["fired"], got["mined"]


def train(docs: DataFrame, labels: DataFrame, held_remainder: int = 0, max_labelled: int = MAX_LABELLED, max_mined: int = MAX_MINED) -> Classifier:
    """Mine voters and fit the classifier on at most ``max_labelled`` labelled training rows.

    The label model's rates are taken over all training rows, labelled or not. Rows of the held-out fold are never read.
    Without labelled rows there are no mined voters, the prior is 0.05, and the label model's own log odds are the
    classifier's weights. Null labels and ids are left out; of several labels of an id the toxic one holds. Rows equal
    in id and text are sampled once, so an id with any number of rows takes no more than its share of the sample.
    """
    learn = docs.where(~fold(F.col("doc_id"), held_remainder)).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    given = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~fold(F.col("doc_id"), held_remainder))
    given = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    given = materialise(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    joined = learn.join(F.broadcast(given), "doc_id")  # max_labelled rows of 12 bytes at most
    labelled = _sampled(joined, max_labelled, joined.count())
    stems = labelled.select("text", "toxic").mapInArrow(_tally, "kind int, stem string, clean long, toxic long").groupBy("kind", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    voters = Voters()
    if clean and toxic:
        odds = F.log(((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1)))
        best = stems.where("toxic >= 3").withColumn("odds", odds).where("odds > 2").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "kind", "stem").limit(max_mined)
        for i, r in enumerate(best.select("kind", "stem").collect()):
            voters.mined[r.kind][r.stem] = i
    n_mined = sum(map(len, voters.mined))
    prior = min(0.5, max(0.01, toxic / (clean + toxic))) if clean + toxic else 0.05

    cells = learn.select("text").mapInArrow(_moments(voters), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both, seen = np.zeros(VOTERS * VOTERS), 0
    for r in cells:  # a row for each pair of voters at most
        if r.cell < 0:
            seen = r.n
        else:
            both[r.cell] = r.n
    both = both.reshape(VOTERS, VOTERS)
    model = LabelModel.fit(both, seen, prior)

    weights = np.zeros(VOTERS + n_mined + 1)
    if clean and toxic:
        y, fired, found = _read(labelled, voters)
        fires = np.zeros((len(fired), VOTERS))
        for i, f in enumerate(fired):
            fires[i, f] = 1
        rows, cols = _design(fired, found, n_mined)
        w = fit_linear(rows, cols, model.posteriors(fires, y), VOTERS + n_mined, 1 / len(y))
        a, b = _calibrate(np.bincount(rows, w[cols], len(y)) + w[-1], y)
        weights = a * w
        weights[-1] += b
    else:
        on, off = np.log(model.toxic / model.clean), np.log((1 - model.toxic) / (1 - model.clean))
        weights[:VOTERS] = np.where(both.diagonal() > 0, model.weight * (on - off), 2.0)
        weights[: len(LEXICON)] = np.maximum(weights[: len(LEXICON)], 4.0)
        weights[-1] = np.log(prior / (1 - prior))
    return Classifier(voters, weights, model)


def score_toxicity(docs: DataFrame, labels: DataFrame, held_remainder: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; only the text enters a score.

    Null text is scored as empty; a null id is not held out; repeated rows each give a row; no rows give none.
    """
    c = train(docs, labels, held_remainder)
    rows = docs.select(F.col("doc_id").cast("long"), fold(F.col("doc_id"), held_remainder).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInArrow(_scores(c.voters, c.weights), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, held_remainder: int = 0) -> DataFrame:
    """The rows and columns of ``docs`` whose text scores under 0.5.

    Null text is scored as empty; rows with a null id are learned from and judged like others; repeated rows stay or
    go together. Columns may have any names. An empty table gives no rows.
    """
    c = train(docs, labels, held_remainder)
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("text", docs_text(docs, names))
    kinds = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))
    scored = rows.mapInArrow(_scores(c.voters, c.weights), f"{kinds}, score double")
    return scored.where("score < 0.5").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def docs_text(docs: DataFrame, names: list[str]):
    return F.col(names[docs.columns.index("text")]).cast("string")
