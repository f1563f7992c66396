import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.lm_scoring import score_documents

SCHEMA = "doc_id long, text string, item string, rows int"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute(rows, order=5):
    """Base and model scores by walking dictionaries, text by text."""
    norm = [(i, (t or "").encode().lower().split()) for i, t in rows]
    train = [t for i, t in norm if not held(i)]
    words = Counter(w for t in train for w in [*t, b""])
    n, v = sum(words.values()), len(words)
    seen = defaultdict(Counter)
    for t in train:
        s = b"\xff" * order + b" ".join(t) + b"\xff"
        for j in range(order, len(s)):
            for k in range(order, -1, -1):
                new = s[j] not in seen[s[j - k : j]]
                seen[s[j - k : j]][s[j]] += 1
                if not new:
                    break
    level = [Counter(c for x, d in seen.items() if len(x) == k for c in d.values()) for k in range(order + 1)]
    off = [min(0.95, max(0.05, c[1] / (c[1] + 2 * c[2]))) if c[1] + c[2] else 0.5 for c in level]

    def p(context, symbol):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            left = {x: c for x, c in seen[context[order - k :]].items() if x not in gone}
            if not left:
                continue
            total = sum(left.values())
            if symbol in left:
                return out + math.log10((left[symbol] - off[k]) / total)
            out += math.log10(off[k] * len(left) / total)
            gone |= set(left)
        return out - math.log10(256 - len(gone))

    out = []
    for i, t in norm:
        tokens = [*t, b""]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        s = b"\xff" * order + b" ".join(t) + b"\xff"
        out.append((i, held(i), len(tokens), sum(words[w] > 0 for w in tokens), n, base, sum(p(s[j - order : j], s[j]) for j in range(order, len(s)))))
    return out, p


TEXTS = [
    (0, "the cat sat on the mat"), (1, "the dog sat\ton the log"), (2, ""), (3, None), (4, "  \n\x0b "), (5, "Éa ça the THE"), (None, "a null id"),
    (7, "the cat sat on the mat"), (7, "the cat sat on the mat"), (7, "other text, same id"), (8, "new wörds zq"), (9, "the cat satin mats " * 900), (10, "xyz" * 4000),
]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("share", [4, 1 << 23])
def test_against_brute_force(spark, share):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in score_documents(docs, gram_share=share, word_share=share).collect()), key=key)
    want = sorted(brute(TEXTS)[0], key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_sum_to_one():
    _, p = brute(TEXTS[:8])
    for context in (b"\xff" * 5, b"n the", b"zzzzz", b"he ca"):
        assert sum(10 ** p(context, s) for s in range(256)) == pytest.approx(1)


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert score_documents(none).collect() == []
    only = next(i for i in range(100) if held(i))
    (row,) = score_documents(spark.createDataFrame([(only, "ab", "x", 1)], SCHEMA)).collect()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0
    assert row.score == pytest.approx(-3 * math.log10(256))


def test_held_out_beats_words(spark):
    """With enough training text, held-out texts are likelier under the byte model."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert r[2] > 1000 and r[0] > 1.03 * r[1]
