"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into blocks, and two fingerprints that differ in at most four bits differ in few bits of some
block: in one of 21, 21 and 22 bits by one at most, in one of 32 and 32 bits by two at most. Each block has a covering
code as its anchors: a Hamming code over its first 15 bits, of covering radius one, times every value of its other
bits. A fingerprint has one home anchor a block, the nearest one; it is replicated to every anchor within the covering
radius plus the block's threshold that can be the home of a fingerprint within the threshold. So each close pair meets
at an anchor, and per anchor only homes are compared with visitors.

Either layout finds all pairs. Three blocks have 2^17 anchors each and need 66 copies of a fingerprint; two blocks have
2^28 and need several hundred, which pays once anchors get crowded, so the layout follows the number of fingerprints.
The homes of a crowded anchor are cut into parts of bounded size, each with its own copy of the visitors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_counted, materialise

#: Blocks as lowest bit, bits, and differing bits within reach, for few and for many fingerprints.
NARROW = ((0, 21, 1), (21, 21, 1), (42, 22, 1))
WIDE = ((0, 32, 2), (32, 32, 2))
WIDE_FROM = 1 << 24
HAMMING = 15
#: Homes of an anchor that are compared with a copy of its visitors.
CROWD = 4_096
#: Crowded anchors whose list is small enough to be sent to all tasks.
SENT = 100_000
SLICE = 4096


def _fingerprint(text: bytes, width: int = 4) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    stops = ends[width - 1 :].tolist()
    for at in range(0, n, SLICE):
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at : at + SLICE], stops[at : at + SLICE], strict=True)), ">u8", min(SLICE, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        fp = np.fromiter((_fingerprint(t or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.record_batch([*batch.drop_columns(["text"]).columns, pa.array(fp)], [*(n for n in batch.schema.names if n != "text"), "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but for ``text``, and ``fp``: the 64-bit SimHash of 4-word shingles as a signed long."""
    kept = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return docs.mapInArrow(_fingerprints, f"{kept}, fp long")


def _syndrome(bits: Column, width: int) -> Column:
    """Position (from 1) of the bit to flip to reach the Hamming code of that width; 0 for a code word."""
    out = F.lit(0)
    for i in range(width.bit_length()):
        mask = sum(1 << (p - 1) for p in range(1, width + 1) if p >> i & 1)
        out = out + F.shiftleft(F.bit_count(bits.bitwiseAND(F.lit(mask))) % 2, i)
    return out


def _home(block: Column) -> Column:
    """The nearest anchor of a block's value."""
    s = _syndrome(block, HAMMING)
    return block.bitwiseXOR(F.when(s == 0, F.lit(0)).otherwise(F.expr("1L") * F.pow(F.lit(2), s - 1).cast("long")).cast("long"))


def _tag(block: int):
    return lambda home: F.shiftleft(home, 2).bitwiseOR(F.lit(block))


def _flips(size: int, reach: int) -> list[int]:
    """The values of ``size`` bits with at most ``reach`` ones."""
    return [sum(1 << i for i in bits) for n in range(reach + 1) for bits in combinations(range(size), n)]


def anchors(fps: DataFrame, visiting: bool, layout: tuple = NARROW) -> DataFrame:
    """``fp`` with ``anchor``: its homes, or all anchors that it is replicated to."""
    rows = []
    for k, (low, size, reach) in enumerate(layout):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << size) - 1))
        flips = _flips(size, reach * visiting)
        if len(flips) < 100:
            near = F.array(*(value.bitwiseXOR(F.lit(m)) for m in flips))
        else:
            near = F.transform(F.array(*(F.lit(m).cast("long") for m in flips)), value.bitwiseXOR)
        rows.append(F.transform(F.transform(near, _home), _tag(k)))
    return fps.select("fp", F.explode_outer(F.array_distinct(F.concat(*rows))).alias("anchor"))


def links(fps: DataFrame, threshold: int = 4, layout: tuple = NARROW, crowd: int = CROWD) -> DataFrame:
    """Pairs ``u < v`` of distinct fingerprints that differ in at most ``threshold`` (4 at most) bits."""
    if threshold > 4:
        raise ValueError("the blocks find pairs of up to four differing bits")
    home = anchors(fps, False, layout).withColumnRenamed("fp", "u")
    visit = anchors(fps, True, layout).withColumnRenamed("fp", "v")
    many = materialise(home.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor", F.ceil(F.col("count") / crowd).cast("int").alias("parts")))
    found = many.count()
    keys = ["anchor"]
    if found:
        sent = F.broadcast(many) if found <= SENT else many
        parts = F.coalesce("parts", F.lit(1))
        home = home.join(sent, "anchor", "left").withColumn("part", F.pmod(F.xxhash64("u"), parts)).drop("parts")
        visit = visit.join(sent, "anchor", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("parts")
        keys = ["anchor", "part"]
    close = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)
    # merged, never sent: a table is sized by what is read, before each row becomes 66 copies or several hundred
    return home.hint("merge").join(visit.hint("merge"), keys).where(close).select("u", "v")


def _grouped(docs: DataFrame, threshold: int) -> DataFrame:
    """The columns of ``docs`` but for its text, with ``fp``, ``component`` and ``component_id``."""
    held = materialise(fingerprints(docs))
    total = held.count()
    counted = held.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // 250_000))  # each replicates what it holds
    nodes = materialise(counted.repartition(tasks))
    distinct = nodes.count()
    roots = connected_components(links(nodes.select("fp"), threshold, WIDE if distinct > WIDE_FROM else NARROW))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    known = join_counted(named.withColumnRenamed("n", "docs"), ids, "component", distinct)
    return join_counted(held, known.select("fp", "component", "component_id", F.col("docs").alias("n")), "fp", total)


def near_duplicates(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id, component`` for each row of ``docs``.

    Fingerprints link at ``threshold`` or fewer differing bits; ``component_id`` is the smallest id reachable, itself
    included, and ``component`` the smallest fingerprint of the component (as a signed long), which names it even
    where ids are null or repeat. Exact copies share a fingerprint and are one node, so copies are never expanded
    into pairs. Texts without words, null ones among them, have fingerprint zero. A null id counts as larger than all
    others: only a component of null ids has a null id. An empty table gives no rows.
    """
    found = _grouped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), threshold)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")


def keep_one(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """``docs`` with one row left of each near-duplicate component, the one with the smallest id.

    Ties on the id go to the smaller hash of the text; of rows equal in both, one stays. Nulls come last, null texts
    are empty ones. Columns may have any names; all are kept as they are. An empty table gives no rows.
    """
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    own = docs.toDF(*names)
    own = own.withColumns({"doc_id": F.col(at["doc_id"]).cast("long"), "text": F.col(at["text"]).cast("string")})
    own = own.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = _grouped(own.select("doc_id", "text", "mark"), threshold)
    rows = found.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("same"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "same")).alias("best")
    best = rows.groupBy("component").agg(first).select(F.col("best.doc_id").alias("b_id"), F.col("best.mark").alias("b_mark"), F.col("best.same").alias("same"))
    left = own.join(best, own.mark.eqNullSafe(best.b_mark) & own.doc_id.eqNullSafe(best.b_id))
    once = left.where("same = 1").select(names)
    return once.unionByName(left.where("same > 1").dropDuplicates(["b_id", "b_mark"]).select(names)).toDF(*docs.columns)
