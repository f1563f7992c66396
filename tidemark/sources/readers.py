"""Typed readers: parquet tables, JSON slices, CSV and JSON imports, fixed-width masters, archives, HTML and API payloads."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import macro_name, number

BAR = "symbol string, trade_date date, open double, high double, low double, close double, volume long"
EVENT_WINDOW = (
    "scenario_id string, market string, symbol string, ticker_id int, event_time timestamp, anchor_date date, reference_date date, side_bias string, signal_strength double, confidence double, "
    "current_price double, atr_pct double, expected_horizon_days int, outcome_label string, provenance string, diagnostics string, notes string"
)


def scan(spark: SparkSession, path: str, symbols: Sequence[str] = (), start: str | None = None, stop: str | None = None, warm_up: int = 0, day: str = "trade_date", symbol: str = "symbol") -> DataFrame:
    """Bars of the symbols between two days, with ``warm_up`` calendar days before; both predicates reach the files."""
    df = spark.read.parquet(path)
    if symbols:
        df = df.where(F.col(symbol).isin(list(symbols)))
    if start:
        df = df.where(F.col(day) >= F.date_sub(F.lit(start).cast("date"), warm_up))
    return df.where(F.col(day) <= F.lit(stop).cast("date")) if stop else df


def scenario(spark: SparkSession, path: str, scenario_id: str, start: str, stop: str) -> DataFrame:
    """Event windows of one scenario (a partition of the table); an empty one is an error."""
    at = F.coalesce("reference_date", "anchor_date")
    df = spark.read.parquet(path).where(F.col("scenario_id") == scenario_id).where(at.between(F.lit(start).cast("date"), F.lit(stop).cast("date")))
    if df.isEmpty():
        raise ValueError(f"scenario {scenario_id!r} has no rows between {start} and {stop}")
    return df


def split_warm_up(candidates: DataFrame, start: str) -> tuple[DataFrame, DataFrame]:
    """Rows in range and rows of the warm-up before it."""
    at = F.coalesce("reference_date", "anchor_date")
    return candidates.where(at >= F.lit(start).cast("date")), candidates.where(at < F.lit(start).cast("date"))


def json_slice(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Bars and candidates of a JSON slice: ``bars_by_symbol`` maps a symbol to its bars."""
    bar = "timestamp string, open double, high double, low double, close double, volume double"
    schema = f"bars_by_symbol map<string,array<struct<{bar.replace(' ', ':').replace(',:', ',')}>>>, candidates array<map<string,string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    bars = raw.select(F.explode("bars_by_symbol").alias("symbol", "bars")).select("symbol", F.explode("bars").alias("b"))
    bars = bars.select("symbol", F.to_date(F.substring("b.timestamp", 1, 10)).alias("trade_date"), "b.open", "b.high", "b.low", "b.close", F.coalesce("b.volume", F.lit(0.0)).cast("long").alias("volume"))
    return {"bars": bars, "candidates": raw.select(F.explode("candidates").alias("candidate"))}


def import_rows(spark: SparkSession, path: str, schema: str = EVENT_WINDOW, defaults: dict | None = None) -> DataFrame:
    """Rows of a CSV, JSON-lines or JSON file as the schema's types: what doesn't parse is null, then its default."""
    names = [(p.split()[0], p.split()[1]) for p in schema.split(", ")]
    text = ", ".join(f"{n} string" for n, _ in names)
    if path.endswith(".csv"):
        raw = spark.read.csv(path, header=True)
        raw = raw.select(*(F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n, _ in names))
    else:
        raw = spark.read.schema(text).json(path, multiLine=not path.endswith(".jsonl"))
    typed = [F.trim(n).try_cast(t).alias(n) for n, t in names]
    return raw.select(*typed).fillna(defaults or {})


def json_or_default(column: str, schema: str, default: str) -> F.Column:
    return F.coalesce(F.from_json(column, schema), F.from_json(F.lit(default), schema))


def fixed_width(spark: SparkSession, path: str, tail: int, head: dict[str, tuple[int, int]], fields: dict[str, tuple[int, int]]) -> DataFrame:
    """A master file whose lines end in a block of ``tail`` fixed-width characters: name to (start from 0, length)."""
    line = spark.read.text(path).where(F.length("value") > tail)
    front, back = F.expr(f"left(value, length(value) - {tail})"), F.right("value", F.lit(tail))
    cut = lambda c, spec: [F.trim(F.substring(c, a + 1, n)).alias(k) for k, (a, n) in spec.items()]
    return line.select(*cut(front, head), *cut(back, fields))


def zipped_xml(spark: SparkSession, path: str, item: str, fields: Sequence[str]) -> DataFrame:
    """Elements of the XML files inside ZIP archives, one row each, archives spread over tasks."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        rows = [[(e.findtext(f) or "").strip() or None for f in fields] for _, e in ET.iterparse(z.open(name)) if e.tag == item]
                        yield pd.DataFrame(rows, columns=list(fields), dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, ", ".join(f"{f} string" for f in fields))


def html_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of HTML tables: page columns, ``row`` and the plain text of its cells."""
    tr = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    out = pages.select(*(c for c in pages.columns if c != html), F.posexplode(tr).alias("row", "tr"))
    cells = F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return out.withColumn("cells", F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), r"\s+", " ")))).drop("tr")


def daily_payload(df: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    """Daily bars of API answers: an array of objects of strings; commas go, bad days and missing closes are dropped."""
    item = "array<struct<date:string,open:string,high:string,low:string,close:string,volume:string>>"
    out = df.select(*keys, F.explode(F.from_json(payload, item)).alias("x"))
    out = out.select(*keys, F.try_to_date("x.date", "yyyyMMdd").alias("trade_date"), *(number(F.col(f"x.{c}")).alias(c) for c in ("open", "high", "low", "close")), F.coalesce(number(F.col("x.volume")), F.lit(0.0)).cast("long").alias("volume"))
    return out.where("trade_date IS NOT NULL AND close IS NOT NULL")


def macro_observations(df: DataFrame) -> DataFrame:
    """Macro values (``name, obs_date, value`` as text): canonical names, a lone dot is missing, publish time in UTC."""
    out = df.withColumns({"raw_name": F.col("name"), "name": macro_name(F.col("name")), "is_missing": F.trim("value") == ".", "value": F.when(F.trim("value") != ".", F.trim("value").try_cast("double"))})
    at = F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format("obs_date", "yyyy-MM-dd"), F.lit(" 16:00:00"))), "America/New_York")
    return out.where("name IS NOT NULL").withColumn("source_ts_utc", at)


def uncovered(wanted: DataFrame, sessions: DataFrame, on: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """Symbols with their session data, and those that have none."""
    return wanted.join(sessions, on), wanted.join(sessions, on, "left_anti")
