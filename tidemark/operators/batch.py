"""Detection, vectors and search of many keys as one job that may be run again: only keys whose input changed are worked on.

Under the root lie the tables of the stages and a log of keys, each cut by run. A run writes the rows of its keys under
its own number and logs those keys, with the content hash of their input, last of all; so a run that broke off has
logged nothing and is done again under the same number. What counts for a key is what its newest logged run wrote. A
run in which no key has changed writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import row_hash
from ..session import held
from . import shapes as H
from . import vectors as X
from .windows import frame

def key_digests(rows: DataFrame, key: str) -> DataFrame:
    """``key, digest``: content hash of each key's rows as a multiset; sums of row hashes, so a large key is no single task."""
    h = rows.select(F.col(key).alias("key"), row_hash(rows).alias("h"))
    limbs = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = h.groupBy("key").agg(F.count("*").cast("string").alias("n"), *(F.sum(x).cast("string").alias(f"s{i}") for i, x in enumerate(limbs)))
    return sums.select("key", F.sha2(F.concat_ws(":", "n", *(f"s{i}" for i in range(8))), 256).alias("digest"))


class Batch:
    """The stored tables of one job. ``stages`` makes a table of each stage from the changed keys' rows and the tables so far."""

    def __init__(self, spark: SparkSession, root: str, stages: dict[str, Callable[[DataFrame, Batch], DataFrame]]):
        self.spark, self.root, self.stages = spark, root.rstrip("/"), stages

    def _runs(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/keys/run=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found or [])

    def _read(self, table: str, runs: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*(f"{self.root}/{table}/run={r}" for r in runs))

    def keys(self) -> DataFrame | None:
        """``key, digest, run`` of what counts now: a key's newest; keys that have gone have a null digest. Null before the first run."""
        runs = self._runs()
        if not runs:
            return None
        newest = F.max_by(F.struct("digest", "run"), "run").alias("x")
        return self._read("keys", runs).groupBy("key").agg(newest).select("key", "x.digest", "x.run")

    def table(self, stage: str) -> DataFrame | None:
        """The rows of a stage that count, without those of keys that have gone or been done again."""
        keys = self.keys()
        if keys is None:
            return None
        live = keys.where("digest IS NOT NULL").select(F.col("key").alias("__key"), F.col("run").alias("__run"))
        rows = self._read(stage, self._runs())
        return rows.join(live, rows["key"].eqNullSafe(live["__key"]) & (rows["run"] == live["__run"]), "left_semi")

    def run(self, rows: DataFrame, key: str = "key") -> dict[str, int]:
        """Bring the tables up to date with ``rows``, the whole input; gives how many keys were new or changed, and gone. Null keys are one key."""
        now, known, runs = held(key_digests(rows, key)), self.keys(), self._runs()
        if known is None:
            todo, gone = now, now.limit(0).select("key")
        else:
            known = held(known.where("digest IS NOT NULL"))
            same = now.join(known.select(F.col("key").alias("k"), F.col("digest").alias("d")), now["key"].eqNullSafe(F.col("k")) & (now["digest"] == F.col("d")), "left_semi")
            todo = now.exceptAll(same)
            here = now.select(F.col("key").alias("k"))
            gone = known.join(here, known["key"].eqNullSafe(here["k"]), "left_anti").select("key")
        todo, gone = held(todo), held(gone)
        counts = {"changed": todo.count(), "gone": gone.count()}
        if not any(counts.values()):
            return counts
        number = runs[-1] + 1 if runs else 0
        changed = todo.select(F.col("key").alias("__key"))
        self.current = held(rows.join(changed, rows[key].eqNullSafe(changed["__key"]), "left_semi"))
        self.left_out = todo.select("key").union(gone)
        for stage, make in self.stages.items():
            make(self.current, self).write.mode("overwrite").parquet(f"{self.root}/{stage}/run={number}")
            setattr(self, f"new_{stage}", self.spark.read.parquet(f"{self.root}/{stage}/run={number}"))
        log = todo.unionByName(gone.withColumn("digest", F.lit(None).cast("string")))
        log.write.mode("overwrite").parquet(f"{self.root}/keys/run={number}")
        return counts

    def everything(self, stage: str) -> DataFrame:
        """While a run is going on: the stage's rows of all keys as they will be after it."""
        new, old = getattr(self, f"new_{stage}"), self.table(stage)
        if old is None:
            return new
        out = self.left_out.select(F.col("key").alias("__out"))
        old = old.join(out, old["key"].eqNullSafe(out["__out"]), "left_anti")
        return old.select(*new.columns).unionByName(new)


def breakouts(bars: DataFrame, lookback: int, rise: float) -> DataFrame:
    """``key, day, path``: bars that close at the highest of ``lookback`` and ``rise`` above the first of these, with those bars."""
    bar = F.struct("open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))
    path = F.collect_list(bar).over(frame(1 - lookback))  # `lookback` bars
    rows = bars.withColumn("path", path).where(F.size("path") == lookback)
    first = F.get("path", F.lit(0))["close"]
    top = F.array_max(F.transform("path", lambda b: b["close"]))
    return rows.where((F.col("close") >= top) & (first > 0) & (F.col("close") / F.nullif(first, F.lit(0.0)) - 1 >= rise)).select("key", "day", "path")


def signal_batch(spark: SparkSession, root: str, lookback: int = 8, rise: float = 0.05, k: int = 3) -> Batch:
    """Breakouts of bars, the shape of each one's path, and its ``k`` nearest among all others' shapes as they stand in that run.

    Keys are whole numbers.
    """

    def signals(bars: DataFrame, batch: Batch) -> DataFrame:
        return breakouts(bars, lookback, rise)

    def vectors(bars: DataFrame, batch: Batch) -> DataFrame:
        return batch.new_signals.select("key", "day", H.shape_v2(*(F.col(f"path.{c}") for c in ("open", "high", "low", "close", "volume"))).alias("vector"))

    def matches(bars: DataFrame, batch: Batch) -> DataFrame:
        row = F.col("key").cast("long") * 1_000_000 + F.datediff("day", F.lit("1970-01-01"))
        asked = batch.new_vectors.select(row.alias("q"), F.col("vector").alias("qv"))
        pool = batch.everything("vectors").select(row.alias("id"), F.col("vector").alias("v"))
        top = X.top_similar(X.nearest(asked, pool, k), ["q"], k)
        return top.select(F.floor(F.col("q") / 1_000_000).cast("long").alias("key"), F.date_add(F.lit("1970-01-01").cast("date"), F.pmod("q", F.lit(1_000_000)).cast("int")).alias("day"), "rank", F.col("id").alias("match"), "sim")

    return Batch(spark, root, {"signals": signals, "vectors": vectors, "matches": matches})
