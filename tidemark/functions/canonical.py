"""Canonical texts and content hashes of values, rows and tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = 8


def _plain(value):
    if isinstance(value, float):
        return round(value, PLACES) + 0.0
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def spec_hash(spec: dict, digits: int = 16) -> str:
    """The beginning of the sha256 of a small specification as JSON: keys sorted, no spaces, floats to eight places."""
    return hashlib.sha256(json.dumps(_plain(spec), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:digits]


def canonical(x: Column, kind: T.DataType) -> Column:
    """A value as text: keys of structs and maps sorted, floats with eight places (no negative zero), strings as JSON, null as ``null``."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        text = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(json.dumps(f.name) + ":"), canonical(x[f.name], f.dataType)) for f in fields)), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: canonical(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(canonical(e["key"].cast("string"), T.StringType()), F.lit(":"), canonical(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_entries(x), pair)), ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = F.format_string(f"%.{PLACES}f", F.round(x.cast("double"), PLACES) + F.lit(0.0))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = x.cast("string")
    else:
        quoted = F.to_json(F.struct(x.cast("string").alias("v")))  # {"v":"..."}
        text = quoted.substr(F.lit(6), F.length(quoted) - 6)
    return F.when(x.isNull(), "null").otherwise(text)


def row_hash(df: DataFrame) -> Column:
    """sha256 of a row's canonical text, whatever the order of the columns."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    parts = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical(F.col(f"`{f.name}`"), f.dataType)) for f in fields]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).cast("binary"), 256)


def table_hash(df: DataFrame) -> str:
    """Content hash of a table as a multiset of rows: the same for any order of rows, columns and partitions.

    Row hashes are added up as eight numbers of 32 bits, so tasks send one row each; names and types of columns and the
    number of rows count too. An empty table has a hash.
    """
    limbs = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = df.select(row_hash(df).alias("h")).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).alias(f"s{i}") for i, x in enumerate(limbs))).first()
    kinds = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return spec_hash({"columns": kinds, "rows": sums["n"], "sums": [str(int(sums[f"s{i}"])) for i in range(8)]}, 64)
