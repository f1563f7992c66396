"""Writers: panels, results as tables, scenario snapshots and incremental mirrors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import melt, upsert

WRITES = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|copy|call)\b", re.I)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes))


def panel(df: DataFrame, path: str, formats: Sequence[str] = ("parquet", "csv")) -> None:
    for kind in formats:
        out = (flat(df) if kind == "csv" else df).write.mode("overwrite")
        (out.option("header", True) if kind == "csv" else out).format(kind).save(f"{path}/{kind}")


def run_tables(runs: DataFrame, trades: DataFrame, metrics: DataFrame, path: str, keys: Sequence[str] = ("run_id",)) -> None:
    """Runs, trades and metrics (as key-value rows) appended to three tables partitioned by run."""
    for name, df in (("runs", runs), ("trades", trades), ("metrics", melt(metrics, keys))):
        df.write.mode("append").partitionBy(*keys).parquet(f"{path}/{name}")


def scenario_snapshot(df: DataFrame, path: str, manifest: str) -> None:
    """Replace the scenarios in ``df`` (only their partitions) and append to the manifest what was written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scenario_id").parquet(path)
    df.groupBy("scenario_id").agg(F.count("*").alias("n_rows"), F.current_timestamp().alias("written_at")).write.mode("append").parquet(manifest)


def artifacts(df: DataFrame, path: str, run_id: str) -> None:
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def ensure_select(sql: str, blocked: Sequence[str] = ()) -> str:
    """The statement, if it only reads and names no blocked prefix."""
    body = re.sub(r"--[^\n]*|/\*.*?\*/|'[^']*'", " ", sql, flags=re.S).strip()
    if not re.match(r"(select|with)\b", body, re.I) or WRITES.search(body) or ";" in body.rstrip(";"):
        raise ValueError("only a single SELECT is allowed")
    if bad := [b for b in blocked if re.search(rf"\b{re.escape(b)}", body, re.I)]:
        raise ValueError(f"not allowed here: {', '.join(bad)}")
    return sql


def newer(df: DataFrame, cursor: str, last: object | None) -> DataFrame:
    """Rows past the last seen cursor value; all of them the first time."""
    return df if last is None else df.where(F.col(cursor) > F.lit(last))


def mirror(spark: SparkSession, source: DataFrame, path: str, keys: Sequence[str], mode: str = "cursor_upsert", cursor: str | None = None) -> int:
    """Bring a mirror table up to date and return the rows taken: ``full`` and ``resync`` rewrite it, ``cursor_upsert``
    merges rows past the largest cursor it holds. The new version is written beside the old and then takes its place."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = spark.read.parquet(path) if mode == "cursor_upsert" and fs.exists(fs_path) else None
    taken = newer(source, cursor, old.agg(F.max(cursor)).first()[0]) if old is not None and cursor else source
    n = taken.count()
    if old is not None and not n:
        return 0
    new = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    (upsert(old, taken, keys) if old is not None else taken).write.mode("overwrite").parquet(path + ".new")
    fs.delete(fs_path, True)
    fs.rename(new, fs_path)
    return n
