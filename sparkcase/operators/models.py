"""Anomaly models as pyspark.ml pipelines, and an isolation forest built per sample.

Boosted trees, PCA error and the perceptron stand in, by role and not by number,
for other boosted trees, an autoencoder and a network with dropout.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

FEATURES = ["log_amount", "z", "above_max", "sum_24h", "n_prior", "n_10min", "n_1h", "n_24h", "n_7d", "log_gap", "hour_off", "n_counterparty", "n_same_amount"]


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight: classes count alike."""
    share = df.agg(F.avg(F.col(label).cast("double")).alias("share"))  # one row
    weight = F.when(F.col(label).cast("boolean"), 0.5 / F.greatest("share", F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("share"), F.lit(1e-9)))
    return df.join(F.broadcast(share)).withColumn("weight", weight).drop("share")


def _stages(features: list[str], last) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), last])


def classifier(kind: str, features: list[str] = FEATURES, seed: int = 7) -> Pipeline:
    """logistic, forest, boosted or perceptron."""
    common = {"featuresCol": "features", "labelCol": "label"}
    last = {
        "logistic": lambda: LogisticRegression(weightCol="weight", maxIter=100, **common),
        "forest": lambda: RandomForestClassifier(numTrees=50, minInstancesPerNode=3, weightCol="weight", seed=seed, **common),
        "boosted": lambda: GBTClassifier(maxDepth=5, maxIter=30, stepSize=0.1, subsamplingRate=0.8, weightCol="weight", seed=seed, **common),
        "perceptron": lambda: MultilayerPerceptronClassifier(layers=[len(features), 32, 16, 2], maxIter=50, seed=seed, **common),
    }[kind]()
    return _stages(features, last)


def fit(kind: str, train: DataFrame, features: list[str] = FEATURES, label: str = "label") -> PipelineModel:
    return classifier(kind, features).fit(balanced(train.withColumn("label", F.col(label).cast("int"))))


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


def drivers(model: PipelineModel, df: DataFrame, features: list[str] = FEATURES, top: int = 3) -> DataFrame:
    """The largest contributions to a logistic score: coefficient times the standardised feature."""
    scaler, last = model.stages[1], model.stages[2]
    parts = [
        F.struct((-F.abs((F.col(f).cast("double") - float(m)) / (float(s) or 1.0) * float(c))).alias("order"), F.lit(f).alias("feature"),
                 ((F.col(f).cast("double") - float(m)) / (float(s) or 1.0) * float(c)).alias("contribution"))
        for f, m, s, c in zip(features, scaler.mean, scaler.std, last.coefficients)
    ]
    return df.withColumn("drivers", F.transform(F.slice(F.array_sort(F.array(*parts)), 1, top), lambda x: F.struct(x["feature"], x["contribution"])))


def reconstruction_error(df: DataFrame, features: list[str] = FEATURES, k: int = 4, label: str | None = None) -> DataFrame:
    """df with score: squared distance of the standardised row from its image on k principal axes."""
    train = df if label is None else df.filter(~F.col(label).cast("boolean"))
    model = _stages(features, PCA(k=k, inputCol="features", outputCol="axes")).fit(train)
    rows = model.transform(df).withColumns({"x": vector_to_array("features"), "a": vector_to_array("axes")})
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)  # noqa: E731  the axes are orthonormal
    return rows.withColumn("score", F.greatest(squares(F.col("x")) - squares(F.col("a")), F.lit(0.0))).drop("raw", "features", "axes", "x", "a")


def _tree(rows: np.ndarray, rng: np.random.Generator, depth: int) -> dict:
    spread = rows.max(axis=0) > rows.min(axis=0) if len(rows) else np.zeros(0, bool)
    if depth == 0 or len(rows) < 2 or not spread.any():
        return {"n": len(rows)}
    f = int(rng.choice(np.flatnonzero(spread)))
    at = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
    left = rows[:, f] < at
    return {"f": f, "at": at, "l": _tree(rows[left], rng, depth - 1), "r": _tree(rows[~left], rng, depth - 1)}


def _usual(n: int) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_forest(df: DataFrame, features: list[str] = FEATURES, trees: int = 100, sample: int = 256, seed: int = 7, key: str = "transaction_id") -> DataFrame:
    """df with score in 0..1 (1: isolated at once).

    Every tree has a sample of rows by hash: a row joins a tree with the chance
    that gives `sample` rows on average, so one pass deals out all samples. The
    trees are built in parallel; they are small (trees * sample rows) whatever
    the table's size, and are broadcast to score all rows in Arrow batches.
    """
    n = max(df.count(), 1)
    values = F.array(*[F.col(f).cast("double") for f in features])
    modulus = 1 << 30
    drawn = df.select(F.col(key).alias("k"), values.alias("v")).withColumn("tree", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("k", t, F.lit(seed)), F.lit(modulus)) < int(min(1.0, sample / n) * modulus))))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        rows = np.nan_to_num(np.array(part.sort_values("k")["v"].tolist(), float))
        built = _tree(rows, np.random.default_rng(seed * 100_003 + tree), math.ceil(math.log2(max(len(rows), 2))))
        return pd.DataFrame({"tree": [tree], "n": [len(rows)], "body": [json.dumps(built)]})

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, n int, body string").orderBy("tree").collect()
    forest = df.sparkSession.sparkContext.broadcast([(r["n"], json.loads(r["body"])) for r in grown])
    typical = sum(_usual(r["n"]) for r in grown) / max(len(grown), 1)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.array(v.tolist(), float)).reshape(len(v), len(features))
        depth = np.zeros(len(x))
        for _, root in forest.value:
            stack = [(root, np.arange(len(x)), 0)]
            while stack:
                node, at, d = stack.pop()
                if "n" in node:
                    depth[at] += d + _usual(node["n"])
                elif len(at):
                    left = x[at, node["f"]] < node["at"]
                    stack += [(node["l"], at[left], d + 1), (node["r"], at[~left], d + 1)]
        return pd.Series(2.0 ** (-depth / max(len(forest.value), 1) / (typical or 1.0)))

    return df.withColumn("score", score(values))


def codes(df: DataFrame, column: str) -> DataFrame:
    """df with <column>_code, the place of the category in order; the categories are a small aggregate."""
    from pyspark.sql import Window

    found = df.select(column).distinct().withColumn(f"{column}_code", F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(found, column, "left")


def bucket(x: Column, n: int = 1024) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(n)).cast("int")


def scoring_service(split: DataFrame, features: list[str] = FEATURES, label: str = "label") -> DataFrame:
    """split (train, validation, test) with score, drivers, flagged and in_training_period.

    Fitted on train; the threshold is that of the best F1 on validation.
    """
    model = fit("logistic", split.filter("split = 'train'"), features, label)
    best = metrics.f1_threshold(metrics.curve(scored(model, split.filter("split = 'validation'")), label=label)).first()
    out = drivers(model, scored(model, split), features)
    flagged = F.lit(False) if best is None or best["threshold"] is None else F.col("score") >= best["threshold"]
    return out.withColumns({"flagged": flagged, "in_training_period": F.col("split") == "train"})
