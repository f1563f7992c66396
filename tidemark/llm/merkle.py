"""A Merkle manifest of a dataset: one tree of rows for each source, and a tree of the sources' roots above.

What is stored for a parent is its preimage, the concatenated hashes of its children. A row's proof is read off the
preimages of its ancestors: the row's own 64 characters are cut out of its parent's and the rest are its siblings; a
changed row is folded by putting its hash in that place, hashing, and going up.

Rows get their place in their source by one sort over all sources, so a source of any size is spread over many tasks.
BLOCK = FANOUT ** LEVELS consecutive nodes are one row of a stored table, which holds all preimages of that many levels
and the node on top; the tops are the nodes of the next table. A dataset of n rows takes about log(n) / log(729) tables,
each 729 times smaller than the last. A leaf is then joined with one row: its block, which carries the preimages of all
ancestors above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_counted, materialise

FANOUT, LEVELS = 3, 6
BLOCK = FANOUT**LEVELS
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of sources; names of other trees are empty (a null source) or begin with "=".
TOP = "*"


def sha(x: Column) -> Column:
    """Lowercase hex sha256 of a text."""
    return F.sha2(x.cast("binary"), 256)


def row_hash(fields: list[Column]) -> Column:
    """Hash of a row's fields: ``-`` for a null, else its UTF-8 bytes, their number before them."""
    each = [x.cast("string") for x in fields]
    return sha(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in each)))


def leaves(docs: DataFrame, **also: Column) -> DataFrame:
    """``tree, doc_id, leaf``: a leaf for each row, with further columns beside. Trees sort as sources do, the null source first."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long"), row_hash([F.col(c) for c in FIELDS]).alias("leaf"), *(x.alias(n) for n, x in also.items()))


def _local_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of sorted rows among those of their tree in this task, and the task's number."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        if not len(batch):
            continue
        tree = batch.column("tree")
        change = np.concatenate([[tree[0].as_py() != last], pc.not_equal(tree[1:], tree[:-1]).to_numpy(zero_copy_only=False)])
        at = np.arange(len(batch), dtype=np.int64)
        begin = np.maximum.accumulate(np.where(change, at, -1))
        place = np.where(begin >= 0, at - begin, at + seen)
        last, seen = tree[-1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), task, np.int32)), pa.array(place)], names=[*batch.schema.names, "task", "place"])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 in their ``tree`` by ``order``; written, as it is read more than once.

    All rows are sorted over ranges of (tree, order); a tree may span tasks. Only the first tree of a task can begin
    in an earlier one, so at most one row for each task is sent to all to move its places on.
    """
    rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = materialise(rows.mapInArrow(_local_places, f"{kinds}, task int, place long"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shift = local.groupBy("tree", "task").agg(F.count("*").alias("n")).withColumn("shift", before).where("shift IS NOT NULL")
    moved = local.join(F.broadcast(shift.select("tree", "task", "shift")), ["tree", "task"], "left")  # a row for each task at most
    return moved.withColumn("pos", F.col("place") + F.coalesce("shift", F.lit(0))).drop("task", "place", "shift")


def _blocks(nodes: DataFrame, totals: DataFrame, rows: int) -> DataFrame:
    """``tree, block, n, levels, top`` of nodes ``tree, pos, hash``: the preimages of up to LEVELS levels of each block.

    ``totals`` has the number ``n`` of nodes of each tree. A level is made while its tree has more than one node.
    """
    held = nodes.groupBy("tree", F.expr(f"pos DIV {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("h"))  # BLOCK nodes at most
    keyed = totals.withColumn("all", F.col("n")).withColumn("n", F.expr(f"(n - 1) DIV {BLOCK} + 1"))
    held = join_counted(held, keyed, "tree", rows // BLOCK + 1).withColumnRenamed("all", "n").withColumn("h", F.col("h.hash"))
    names = []
    for level in range(LEVELS):
        made = F.transform(F.sequence(F.lit(0), F.floor((F.size("h") - 1) / FANOUT).cast("int")), lambda i: F.array_join(F.slice("h", i * FANOUT + 1, FANOUT), ""))
        names.append(f"level_{level}")
        held = held.withColumn(names[-1], F.when(F.col("n") > FANOUT**level, made))
        held = held.withColumn("h", F.when(F.col(names[-1]).isNotNull(), F.transform(names[-1], sha)).otherwise(F.col("h")))
    levels = F.array_compact(F.array(*names))
    return held.select("tree", "block", "n", levels.alias("levels"), F.get("h", F.lit(0)).alias("top"))


def within(levels: Column, place: Column) -> Column:
    """The preimages above the node at ``place`` of a block, and which of the parent's slots is the node's."""
    return F.transform(levels, lambda p, j: F.struct(
        F.get(p, F.floor(place / F.pow(F.lit(FANOUT), j + 1)).cast("int")).alias("preimage"),
        F.floor(place / F.pow(F.lit(FANOUT), j) % FANOUT).cast("int").alias("slot"),
    ))


def _climb(nodes: DataFrame, rows: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the nodes up, and ``tree, hash`` of what remains of each tree."""
    tables, roots = [], None
    while True:
        totals = nodes.groupBy("tree").agg(F.count("*").alias("n"))
        blocks = materialise(_blocks(nodes, totals, rows))
        tables.append(blocks)
        done = blocks.where(F.col("n") <= BLOCK).select("tree", F.col("top").alias("hash"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = blocks.where(F.col("n") > BLOCK).select("tree", F.col("block").alias("pos"), F.col("top").alias("hash"))
        rows = nodes.count()
        if not rows:
            return tables, roots


def _descend(tables: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The lowest table's blocks with ``above``, the path from the block's top to the root, and ``subroot``.

    ``ends`` has these two for what remains of each tree.
    """
    upper = None
    for blocks in reversed(tables):
        last = blocks.where(F.col("n") <= BLOCK).join(ends, "tree")
        if upper is not None:
            parents = upper.select("tree", F.col("block").alias("parent"), F.col("levels").alias("up"), F.col("above").alias("on"), "subroot")
            inner = blocks.where(F.col("n") > BLOCK).withColumn("parent", F.expr(f"block DIV {BLOCK}")).join(parents, ["tree", "parent"])
            path = F.concat(within(F.col("up"), F.col("block") % BLOCK), F.col("on"))
            last = last.unionByName(inner.withColumn("above", path).drop("parent", "up", "on"))
        upper = materialise(last.select("tree", "block", "levels", "above", "subroot"))
    return upper


class Manifest:
    """The stored preimages of a dataset, its root, and its leaves with their places.

    An empty table has no leaves and a null root.
    """

    def __init__(self, rows: DataFrame):
        """``rows`` has ``tree, doc_id, leaf`` and perhaps more. In a tree they ascend by doc_id, null first, equal ids by leaf."""
        self.leaves = placed(rows, ["doc_id", "leaf"])
        self.tables, subroots = _climb(self.leaves.select("tree", "pos", F.col("leaf").alias("hash")), self.leaves.count())
        subroots = placed(subroots.withColumnsRenamed({"tree": "name"}).withColumn("tree", F.lit(TOP)), ["name"])
        self.top, root = _climb(subroots.select("tree", "pos", "hash"), subroots.count())
        found = root.first()
        self.root = found["hash"] if found else None
        empty = F.array().cast("array<struct<preimage:string,slot:int>>")
        over = _descend(self.top, root.select("tree", empty.alias("above"), F.col("hash").alias("subroot"))).drop("subroot")
        subroots = subroots.withColumn("block", F.expr(f"pos DIV {BLOCK}"))
        path = F.concat(within(F.col("levels"), F.col("pos") % BLOCK), F.col("above"))
        self.subroots = subroots.join(over, ["tree", "block"]).select(F.col("name").alias("tree"), path.alias("above"), F.col("hash").alias("subroot"))
        self.blocks = _descend(self.tables, self.subroots)

    def preimages(self) -> DataFrame:
        """``tree, level, pos, preimage, hash``: every parent of the trees, level 1 above the rows; the tree of sources is ``*``."""
        out = None
        for name, tables in ((None, self.tables), (TOP, self.top)):
            for t, blocks in enumerate(tables):
                level = blocks.select("tree", "block", F.posexplode("levels").alias("j", "p"))
                level = level.select(F.lit(name).alias("of") if name else F.col("tree").alias("of"), "block", (F.col("j") + 1).alias("j"), F.posexplode("p").alias("i", "preimage"))
                width = F.floor(F.lit(float(BLOCK)) / F.pow(F.lit(FANOUT), "j")).cast("long")
                rows = level.select(F.col("of").alias("tree"), (F.col("j") + t * LEVELS).alias("level"), (F.col("block") * width + F.col("i")).alias("pos"), "preimage", sha(F.col("preimage")).alias("hash"))
                out = rows if out is None else out.unionByName(rows)
        return out

    def proofs(self) -> DataFrame:
        """The leaves with ``subroot``, ``root`` and ``path``: preimage and own slot at every level up to the root."""
        kept = self.leaves.withColumn("block", F.expr(f"pos DIV {BLOCK}")).join(self.blocks, ["tree", "block"])
        path = F.concat(within(F.col("levels"), F.col("pos") % BLOCK), F.col("above"))
        return kept.withColumn("path", path).withColumn("root", F.lit(self.root).cast("string")).drop("block", "levels", "above")


def siblings(path: Column) -> Column:
    """The other hashes of each run on the way to the root, in one text: every preimage without the own slot."""
    rest = F.transform(path, lambda s: F.concat(s["preimage"].substr(F.lit(1), s["slot"] * DIGEST), s["preimage"].substr((s["slot"] + 1) * DIGEST + 1, F.lit(FANOUT * DIGEST))))
    return F.array_join(rest, "")


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of a path: put in its slot of the preimage and hashed, level by level."""
    return F.aggregate(path, leaf, lambda h, s: sha(F.overlay(s["preimage"], h, s["slot"] * DIGEST + 1, F.lit(DIGEST))))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without newlines where the id's crc32 is even; otherwise, and for a null id, as it is."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verify(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: each row's proof, tried on a tampered copy.

    Null fields, also a null source or id, are fields like any other; repeated rows are leaves one by one. An empty
    table gives no rows.
    """
    at = fresh("found", docs.columns)
    changed = docs.withColumn(at, tampered(F.col("doc_id"), F.col("text").cast("string")))
    other = row_hash([F.col(at if c == "text" else c) for c in FIELDS])
    rows = materialise(leaves(changed, found=other))  # sorting reads it twice
    found = Manifest(rows).proofs()
    folded = found.select("doc_id", "leaf", "subroot", "root", sha(siblings(F.col("path"))).alias("proof_sha256"), fold(F.col("path"), F.col("found")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    crc = """xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
      lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END, 4294967295), 4294967295)"""

    def field(x: str) -> str:
        return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"

    def row(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def tree(name: str, base: str) -> str:
        """All nodes, and the preimages of all parents, of the trees of a table ``tree, pos, n, hash``."""
        return f"""
{name}(tree, level, pos, n, hash, preimage) AS (
  SELECT tree, 0, pos, n, hash, '' FROM {base}
  UNION ALL
  SELECT tree, level + 1, pos // {FANOUT}, (n - 1) // {FANOUT} + 1, sha256(string_agg(hash, '' ORDER BY pos)), string_agg(hash, '' ORDER BY pos)
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // {FANOUT}, n
)"""

    def climb(name: str, base: str, nodes: str) -> str:
        slot = f"pos % {FANOUT} * {DIGEST}"
        return f"""
{name}(id, tree, level, pos, n, folded, proof) AS (
  SELECT id, tree, 0, pos, n, folded, proof FROM {base}
  UNION ALL
  SELECT id, c.tree, c.level + 1, c.pos // {FANOUT}, p.n, sha256(left(preimage, {slot.replace("pos", "c.pos")}) || folded || substr(preimage, {slot.replace("pos", "c.pos")} + {DIGEST + 1})),
         proof || left(preimage, {slot.replace("pos", "c.pos")}) || substr(preimage, {slot.replace("pos", "c.pos")} + {DIGEST + 1})
  FROM {name} c JOIN {nodes} p ON p.tree = c.tree AND p.level = c.level + 1 AND p.pos = c.pos // {FANOUT} WHERE c.n > 1
)"""

    return f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {row("text")} AS leaf,
         CASE WHEN {crc} % 2 = 0 THEN {row("replace(text, chr(10), '')")} ELSE {row("text")} END AS found
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS hash FROM hashed
), {tree("nodes", "leaves")}, subroots AS (
  SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, hash FROM nodes WHERE n = 1
), {tree("top", "subroots")}, low AS (SELECT id, tree, pos, n, found AS folded, '' AS proof FROM leaves), {climb("in_source", "low", "nodes")}, middle AS (
  SELECT id, s.tree, s.pos, s.n, folded, proof FROM in_source c JOIN subroots s ON s.name = c.tree WHERE c.n = 1
), {climb("in_top", "middle", "top")}
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.hash AS verified
FROM leaves l JOIN subroots s ON s.name = l.tree JOIN in_top c ON c.id = l.id AND c.n = 1 JOIN top r ON r.n = 1
"""
