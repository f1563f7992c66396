"""Artifacts of a training period, stored under their content hash and scored only where no test day is mixed in.

An artifact is three small tables and a manifest: the features' scaler, a prototype for each state, and the calibration
of the score. It is written once; a second fit with the same result finds it there. What is loaded is hashed again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as V
from ..functions.canonical import spec_hash, table_hash
from ..session import held
from .statistics import calibration_fit, scaler

TABLES = ("scaler", "prototypes", "calibration")
#: Prototypes that an artifact may have; they are sent to every task.
MAX_PROTOTYPES = 20_000


class ArtifactError(ValueError):
    """An artifact that is missing, changed, or mixed with test days."""


@dataclass(frozen=True)
class Artifact:
    manifest: dict
    scaler: DataFrame
    prototypes: DataFrame
    calibration: DataFrame


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def standardised(features: Sequence[str], scales: DataFrame) -> Column:
    """The features as an array of (x - mean) / std; nulls count as zero. ``scales`` has a row a feature."""
    known = {r["feature"]: r for r in scales.collect()}
    return F.array(*((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - known[f]["mean"]) / known[f]["std"] for f in features))


def expected_value(df: DataFrame, score: str, ret: str) -> DataFrame:
    """Least-squares slope and intercept of the return over the score; slope 1 where the score does not vary."""
    x, y = F.col(score), F.col(ret)
    slope = F.when(F.var_pop(x) <= 1e-12, 1.0).otherwise(F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0)))
    return df.agg(slope.alias("ev_slope"), F.avg(x).alias("mx"), F.avg(y).alias("my")).select("ev_slope", (F.col("my") - F.col("ev_slope") * F.col("mx")).alias("ev_intercept"))


def fit(root: str, spec: dict, rows: DataFrame, features: Sequence[str], train_end: date, test_start: date) -> str:
    """Fit on the rows of days up to ``train_end`` whose outcome was known by then, store, and give the artifact's id.

    ``rows`` has ``day, outcome_day, state`` (a whole number), ``score, ret`` and the features. A row whose outcome
    ends on or after the first test day raises, as does a period without rows. Null scores and returns count as zero,
    rows without a day, outcome day or state take no part.
    """
    spark = rows.sparkSession
    known = (F.col("day") <= F.lit(train_end)) & (F.col("outcome_day") <= F.lit(train_end)) & F.col("state").isNotNull()
    own = {"__score": "score", "__ret": "ret"}  # a feature may have the name of either
    train = held(rows.where(known).select("day", "outcome_day", "state", *dict.fromkeys(features), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in own.items())))
    span = train.agg(F.count("*").alias("n"), F.max("day").alias("day"), F.max("outcome_day").alias("outcome")).first()
    if not span["n"]:
        raise ArtifactError("no training rows")
    _refuse_mixed(span["day"], span["outcome"], test_start)
    scales = held(scaler(train, features))
    z = train.withColumn("z", standardised(features, scales))
    means = [F.avg(F.get("z", F.lit(i))) for i in range(len(features))]
    prototypes = z.groupBy(F.col("state").cast("long").alias("state")).agg(F.count("*").alias("members"), F.avg("__ret").alias("mean_ret"), F.array(*means).alias("vector"))
    fitted = calibration_fit(train.withColumn("__won", (F.col("__ret") > 0).cast("int")), "__score", "__won").crossJoin(expected_value(train, "__score", "__ret"))  # one row each
    tables = {"scaler": scales, "prototypes": held(prototypes), "calibration": held(fitted)}
    manifest = {
        "spec_hash": spec_hash(spec), "features": list(features), "train_end": str(train_end), "test_start": str(test_start), "max_train_day": str(span["day"]), "max_outcome_day": str(span["outcome"]), "rows": span["n"],
    } | {f"{t}_hash": table_hash(df) for t, df in tables.items()}
    name = spec_hash(manifest, 64)
    path = f"{root.rstrip('/')}/{name}"
    if not _exists(spark, f"{path}/manifest/_SUCCESS"):  # the manifest comes last, so a fit that broke off is done again
        for t, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{t}")
        kinds = ", ".join(f"{k} {'array<string>' if k == 'features' else 'long' if k == 'rows' else 'string'}" for k in manifest)
        spark.createDataFrame([tuple(manifest.values())], kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return name


def _refuse_mixed(train_day: date, outcome_day: date, first_test_day: date) -> None:
    if train_day >= first_test_day:
        raise ArtifactError(f"training runs to {train_day}, the test begins on {first_test_day}")
    if outcome_day >= first_test_day:
        raise ArtifactError(f"training outcomes run to {outcome_day}, the test begins on {first_test_day}")


def load(spark: SparkSession, root: str, name: str, first_test_day: date | None) -> Artifact:
    """The artifact of that id; raises if it is not there, if a table or the manifest is not what the id was made of, or if training reaches a test day."""
    path = f"{root.rstrip('/')}/{name}"
    if not _exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ArtifactError(f"no artifact {name}")
    manifest = spark.read.parquet(f"{path}/manifest").first().asDict()
    if spec_hash(manifest, 64) != name:
        raise ArtifactError(f"the manifest of {name} has changed")
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    for t, df in tables.items():
        if table_hash(df) != manifest[f"{t}_hash"]:
            raise ArtifactError(f"{t} of {name} has changed")
    if first_test_day:
        _refuse_mixed(date.fromisoformat(manifest["max_train_day"]), date.fromisoformat(manifest["max_outcome_day"]), first_test_day)
    return Artifact(manifest, **tables)


def score(spark: SparkSession, root: str, name: str, rows: DataFrame) -> DataFrame:
    """``rows`` of test days with ``z``, the nearest prototype's ``match`` and ``similarity``, ``probability`` and ``expected``.

    Similarity is the cosine, equal ones go to the smaller state. Rows without a day take no part.
    """
    rows = rows.where("day IS NOT NULL")
    made = load(spark, root, name, rows.agg(F.min("day")).first()[0])
    if made.prototypes.count() > MAX_PROTOTYPES:
        raise ArtifactError(f"more than {MAX_PROTOTYPES} prototypes")
    near = made.prototypes.agg(F.collect_list(F.struct("state", "vector")).alias("near"))  # MAX_PROTOTYPES at most
    best = F.array_max(F.transform("near", lambda p: F.struct(V.cosine(F.col("z"), p["vector"]).alias("similarity"), (-p["state"]).alias("minus"))))
    x = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    out = rows.withColumn("z", standardised(made.manifest["features"], made.scaler)).crossJoin(F.broadcast(near.crossJoin(made.calibration)))  # one row
    out = out.withColumn("best", best).withColumn("probability", 1 / (1 + F.exp(-(F.col("slope") * x + F.col("intercept"))))).withColumn("expected", F.col("ev_slope") * x + F.col("ev_intercept"))
    return out.withColumns({"match": -F.col("best.minus"), "similarity": F.col("best.similarity")}).drop("best", "near", "slope", "intercept", "ev_slope", "ev_intercept")
