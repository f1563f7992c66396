"""Helpers that the training-text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, remainder: int, parts: int = 5) -> Column:
    """True where crc32 of the id written as text leaves the remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == remainder, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh one where that is unset and all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a materialised table that no later plan reads."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key that holds more rows than this, and than one row in HOT_KEYS, is hot; so there are fewer than HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 50_000, 1_000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and, as ``n``, how many of the ``total`` rows have that key.

    Rows of hot keys stay where they are and get the fewer than HOT_KEYS rows of ``keyed`` sent; all others meet by a
    shuffle in which no key has more than ``max(HOT_ROWS, total / HOT_KEYS)`` rows. ``n`` is dropped.
    """
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    there = rows.join(F.broadcast(keyed.where(hot)), key)  # HOT_KEYS rows at most
    return there.unionByName(rows.join(keyed.where(~hot), key)).drop("n")


def fresh(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores as it needs not to be taken (columns differ by more than case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for each node of an undirected graph.

    ``edges`` has two columns ``u`` and ``v`` of one orderable type. Returns ``node``, ``root`` for every node
    that has an edge to another. Alternates the large-star and small-star steps (Kiveris and others, 2014) until
    the edge set is a forest of stars; every round is written to the shared folder, and only row counts and sums
    reach the driver. A node with very many neighbours is no single task. Self-loops, repeated edges and nulls are
    dropped; no edges give no rows.
    """
    pairs = materialise(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(pairs)
    while before[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        ahead = both.where(F.col("v") > F.col("u"))
        large = join_counted(ahead, low, "u", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, low, "u", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = materialise(small.where(F.col("u") != F.col("v")).distinct())
        drop_table(pairs)
        pairs, now = after, state(after)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(pairs.select(F.col("v"), F.col("v"))).distinct()
