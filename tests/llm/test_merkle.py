import hashlib
import zlib

import duckdb
import pytest

from tidemark.llm import merkle
from tidemark.llm.merkle import Manifest, leaves, oracle, verify


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root of nodes (hash, members); every member's path gets its slot and run, level by level."""
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for run in runs:
            for k, (_, members) in enumerate(run):
                for m in members:
                    m["path"].append((k, [h for h, _ in run]))
        nodes = [(sha(*(h for h, _ in run)), [m for _, ms in run for m in ms]) for run in runs]
    return nodes[0]


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    subroots = []
    for source in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(({"row": r, "leaf": leaf(r), "path": []} for r in rows if r[1] == source), key=lambda m: (m["row"][0] is not None, m["row"][0] or 0, m["leaf"]))
        top, all_of = climb([(m["leaf"], [m]) for m in members])
        for m in all_of:
            m["subroot"] = top
        subroots.append((top, all_of))
    root, members = climb(subroots) if subroots else (None, [])
    out = []
    for m in members:
        i, source, lang, n, text = m["row"]
        if i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            text = text.replace("\n", "")
        folded, siblings = leaf((i, source, lang, n, text)), []
        for k, run in m["path"]:
            siblings += run[:k] + run[k + 1 :]
            folded = sha(*run[:k], folded, *run[k + 1 :])
        out.append((m["row"][0], m["leaf"], m["subroot"], root, sha(*siblings), folded, folded == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def got(docs):
    return sorted((tuple(r) for r in verify(docs).collect()), key=str)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    want = brute(rows)
    assert got(docs) == want
    assert 0 < sum(r[-1] for r in want) < len(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(oracle()).fetchall(), key=str) == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_of_runs(spark, n):
    rows = [(i, "a", None, i, f"x\n{i}") for i in range(n)] + [(100 + i, f"s{i}", "en", 1, "y") for i in range(n)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_many_tables_of_blocks(spark, monkeypatch, levels):
    """Small blocks, so that trees and the tree of sources climb through several tables."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rows = [(i, "hot", "en", i, f"t\n{i}") for i in range(47)] + [(i, f"s{i % 13}", None, None, "u\n") for i in range(100, 141)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nulls_repeats_ties_and_names(spark):
    rows = [(None, None, None, None, None), (1, None, "en", 1, "a\nb"), (1, None, "en", 1, "a\nb"), (1, "", "de", 2, ""), (2, "=", "é", -3, "漢\n" * 5000), (2, "ü", None, 0, None), (None, "ü", "x", 1, "\n"), (7, "z", "", 1, "\n\n")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", tree string, found string").withColumnRenamed("doc_id", "DOC_ID")
    assert got(docs) == brute(rows)
    assert verify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_preimages(spark, sf):
    """Each stored parent is the hash of its preimage, whose parts are leaves or the parents below."""
    found = Manifest(leaves(spark.read.parquet(f"{sf}/documents.parquet")))
    rows = found.preimages().collect()
    below = {(r.tree, r.level, r.pos): r.hash for r in rows} | {(r.tree, 0, r.pos): r.leaf for r in found.leaves.collect()}
    assert found.root in {r.hash for r in rows if r.tree == "*"} and len({(r.tree, r.level, r.pos) for r in rows}) == len(rows)
    for r in rows:
        assert sha(r.preimage) == r.hash
        if r.tree != "*" or r.level > 1:
            assert [r.preimage[i : i + 64] for i in range(0, len(r.preimage), 64)] == [below[r.tree, r.level - 1, 3 * r.pos + k] for k in range(len(r.preimage) // 64)]
