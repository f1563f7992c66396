"""Bounded runs of streams: land what arrives block by block, take all of it, stop, and read the result back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def written(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps each batch under its number, so a batch that is replayed overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def late_by(rows: DataFrame, ts: str, days: int, late: Column, by: int = 1) -> DataFrame:
    """``rows`` with ``arrival``: the number of the block of ``days`` days they belong to, ``by`` blocks later where ``late``."""
    first = rows.agg(F.to_date(F.min(ts)).alias("first")).first()[0]
    block = F.floor(F.datediff(F.to_date(ts), F.lit(first)) / days).cast("int")
    return rows.withColumn("arrival", block + F.when(late, by).otherwise(0))


def run_blocks(rows: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str = "append", sink: Callable[[str], Callable[[DataFrame, int], None]] = written, store: str | None = None) -> DataFrame:
    """The result of the stream ``build`` makes of ``rows`` as they arrive: by ``arrival``, one bounded run a number.

    Each run lands its files beside the earlier ones, starts from the checkpoint of the run before and ends when all is
    taken, so state and watermark are those of a stream that was stopped and started again. Files, checkpoint and result
    are in the shared folder. Rows without an arrival never arrive. ``store`` is the class of the state store, if it
    matters.
    """
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    source, result = f"{folder}/in", f"{folder}/out"
    staged = f"{folder}/staged"
    rows.where("arrival IS NOT NULL").write.partitionBy("arrival").parquet(staged)
    plain = rows.drop("arrival").schema
    numbers = sorted(r[0] for r in rows.select("arrival").where("arrival IS NOT NULL").distinct().collect())  # a number a block
    kind, before = None, spark.conf.get(STORE, None)
    if store:
        spark.conf.set(STORE, store)
    for n in numbers:
        spark.read.schema(plain).parquet(f"{staged}/arrival={n}").write.mode("append").parquet(source)
        out = build(spark.readStream.schema(plain).parquet(source))
        kind = out.schema
        query = out.writeStream.outputMode(mode).foreachBatch(sink(result)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    if store:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    if kind is None:
        return _empty(spark, rows, build)
    return spark.read.schema(kind).parquet(result).select(*kind.names) if _there(spark, result) else spark.createDataFrame([], kind)


def _empty(spark: SparkSession, rows: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    folder = f"{shared_folder(spark)}/none-{uuid.uuid4().hex}"
    rows.drop("arrival").limit(0).write.parquet(folder)
    return spark.createDataFrame([], build(spark.readStream.schema(rows.drop("arrival").schema).parquet(folder)).schema)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
