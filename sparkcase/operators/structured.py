"""Structured output in text: the JSON object in it, its schema errors, and a payload's leaves."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

LEAF = ArrayType(StructType([StructField("path", StringType()), StructField("kind", StringType()), StructField("value", StringType())]))
FREE_TEXT = ("description", "memo", "note", "comment", "text")


def first_object(text: str | None) -> str | None:
    """The first complete JSON object in a text; null if none is complete."""
    at = -1 if text is None else text.find("{")
    while at >= 0:
        try:
            return text[at : at + json.JSONDecoder().raw_decode(text[at:])[1]]
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def _first_object(x: pd.Series) -> pd.Series:
    return x.map(first_object)


def extracted(text: Column) -> Column:
    return _first_object(text)


def parsed(df: DataFrame, body: Column, required: dict[str, str], allowed: dict[str, tuple[str, ...]] | None = None, most: int = 8) -> DataFrame:
    """df with `value` (struct by the required fields) and `errors`, at most `most`, in field order."""
    allowed = allowed or {}
    schema = ", ".join(f"{k} {t}" for k, t in required.items())
    rows = df.withColumn("body", body).withColumn("value", F.from_json("body", schema, {"mode": "PERMISSIVE"}))
    errors = [F.when(F.col("body").isNull(), F.lit("no complete JSON object"))]
    for k in required:
        v = F.col(f"value.{k}")
        errors.append(F.when(F.col("body").isNotNull() & v.isNull(), F.lit(f"{k}: missing or of another type")))
        if k in allowed:
            errors.append(F.when(v.isNotNull() & ~v.isin(*allowed[k]), F.lit(f"{k}: not allowed")))
    return rows.withColumn("errors", F.slice(F.array_compact(F.array(*errors)), 1, most)).drop("body")


@F.pandas_udf(LEAF)
def _leaves(x: pd.Series) -> pd.Series:
    def walk(value, path, out):
        if isinstance(value, dict):
            for k in value:
                walk(value[k], f"{path}.{k}" if path else k, out)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{path}[{i}]", out)
        else:
            kind = "null" if value is None else type(value).__name__
            out.append({"path": path, "kind": kind, "value": None if value is None else str(value)})
        return out

    def of(s):
        try:
            return [] if s is None else walk(json.loads(s), "", [])
        except ValueError:
            return []

    return x.map(of)


def leaves(payload: Column) -> Column:
    """All leaves of a JSON payload: path, kind, value; none if it is no JSON."""
    return _leaves(payload)


def free_text(payload: Column) -> Column:
    """The strings under keys that hold free text."""
    found = F.filter(_leaves(payload), lambda x: (x["kind"] == "str"))
    return F.transform(found, lambda x: x["value"])


def fit_tripwire(labelled: DataFrame, vector: str = "vector", label: str = "label", c: float = 10.0):
    """A balanced logistic model of embeddings: regularised as 1 / (c * n)."""
    n = max(labelled.count(), 1)
    share = labelled.agg(F.avg(F.col(label).cast("double")).alias("share"))  # one row
    rows = labelled.join(F.broadcast(share)).withColumn("weight", F.when(F.col(label) == 1, 0.5 / F.greatest("share", F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("share"), F.lit(1e-9))))
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1.0 / (c * n), standardization=False, maxIter=200)
    return Pipeline(stages=[model]).fit(rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))


def tripwire(model, df: DataFrame, vector: str = "vector", n_words: str | None = None, least_words: int = 3) -> DataFrame:
    """df with trip_score; texts of fewer than least_words words score 0."""
    rows = model.transform(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    score = vector_to_array("probability")[1]
    score = score if n_words is None else F.when(F.col(n_words) >= least_words, score).otherwise(0.0)
    return rows.withColumn("trip_score", score).drop("features", "rawPrediction", "probability", "prediction")


def detectors(flagged: DataFrame, names: list[str], keys: tuple[str, ...] = ("set",)) -> DataFrame:
    """flagged (set, attack, <one boolean per detector>): by set and detector, hits, recall, false positives."""
    long = flagged.unpivot([*keys, "attack"], names, "detector", "hit")
    return long.groupBy(*keys, "detector").agg(
        F.count_if("attack").alias("attacks"), F.count_if(F.col("attack") & F.col("hit")).alias("found"), F.count_if(~F.col("attack") & F.col("hit")).alias("false_positives"),
    ).withColumn("recall", F.when(F.col("attacks") > 0, F.col("found") / F.col("attacks")).otherwise(0.0))
