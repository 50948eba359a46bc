"""Bootstrap intervals of curves and of pair metrics, each in one pass over the rows.

A cluster (a customer, a query) is drawn so many times in a replicate; how many is
a Poisson number that follows from a hash of cluster, replicate and seed, so any
partitioning gives the same. Each task adds its rows' weights to a histogram of
scores for every replicate; the histograms, of a fixed number of bins, are summed,
and curves are read from them. Up to BINS different scores each has its own bin,
and the curves are exact; beyond that bins hold about equally many rows, and scores
in one bin count as tied. Bins never lie across the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLICATES, BINS = 200, 1_024
#: The chances of fewer than 1, 2, ... draws of one cluster (Poisson of mean 1).
_CHANCES = np.cumsum(np.concatenate(([1.0], 1 / np.cumprod(np.arange(1.0, 13))))) * np.exp(-1)


def draws(clusters: np.ndarray, replicates: int) -> np.ndarray:
    """How often each hashed cluster is drawn in each replicate; before them, once in a column of its own: the estimate."""
    with np.errstate(over="ignore"):
        x = clusters.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    drawn = np.searchsorted(_CHANCES, (x >> np.uint64(11)) * 2.0**-53, side="right")
    return np.concatenate((np.ones((len(clusters), 1), np.int64), drawn), axis=1)


def _edges(df: DataFrame, score: str, threshold: float, bins: int) -> np.ndarray:
    """Where bins begin: at every score if there are few, else at about equal shares; and at the threshold."""
    few = [r[0] for r in df.select(score).distinct().limit(bins + 1).collect()]  # bins + 1 values at most
    if len(few) > bins:
        shares = [i / bins for i in range(bins)]
        few = df.agg(F.percentile_approx(score, shares, 20 * bins)).head()[0]
    return np.unique(np.array([*few, threshold], float))


def _histograms(df: DataFrame, score: str, label: str, cluster: str, edges: np.ndarray, replicates: int, seed: int) -> DataFrame:
    """(r, bin, p, n): by replicate, the weight of positives and of all rows in each bin; r = 0 has each row once."""
    size = len(edges) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n = np.zeros((size, replicates + 1)), np.zeros((size, replicates + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                c, s, y = (col.to_numpy(zero_copy_only=False) for col in batch.slice(at, 2_000).columns)
                w, place = draws(c, replicates), np.searchsorted(edges, s.astype(float), side="right")
                for total, rows in ((n, np.arange(len(s))), (p, np.flatnonzero(y))):
                    if len(rows):
                        order = rows[np.argsort(place[rows], kind="stable")]
                        starts = np.flatnonzero(np.diff(place[order], prepend=-1))
                        total[place[order][starts]] += np.add.reduceat(w[order], starts, axis=0)
        b, r = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(b, pa.int32()), pa.array(p[b, r]), pa.array(n[b, r])], names=["r", "bin", "p", "n"])

    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        F.xxhash64(cluster, F.lit(seed)).alias("c"), F.col(score).cast("double").alias("s"), F.col(label).cast("boolean").alias("y"))
    return rows.mapInArrow(run, "r int, bin int, p double, n double").groupBy("r", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def _intervals(by_replicate: DataFrame, names: list[str]) -> DataFrame:
    """(metric, estimate, low, high): replicate 0 and the 95 % percentiles of the others."""
    long = by_replicate.unpivot(["r"], names, "metric", "value")
    again = F.when(F.col("r") > 0, F.col("value"))
    return long.groupBy("metric").agg(
        F.max(F.when(F.col("r") == 0, F.col("value"))).alias("estimate"), F.percentile(again, F.lit(0.025)).alias("low"), F.percentile(again, F.lit(0.975)).alias("high"))


def curves(df: DataFrame, threshold: float, score: str = "score", label: str = "label", cluster: str = "cluster", replicates: int = REPLICATES, bins: int = BINS, seed: int = 1) -> DataFrame:
    """(metric, estimate, low, high) of PR-AUC, ROC-AUC and the F1 at a threshold (inclusive), clusters drawn with replacement.

    Replicates without positives (ROC-AUC: without negatives too) say nothing and do not count. Null scores and labels do not count.
    """
    edges = _edges(df.filter(F.col(score).isNotNull()), score, threshold, bins)
    counted = _histograms(df, score, label, cluster, edges, replicates, seed)
    flagged = F.col("bin") >= int(np.searchsorted(edges, threshold, side="right"))
    down, every = Window.partitionBy("r").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("r")  # the bins of a replicate
    rows = counted.withColumns({"tp": F.sum("p").over(down), "seen": F.sum("n").over(down), "pos": F.sum("p").over(every), "all": F.sum("n").over(every)})
    own, below = F.col("n") - F.col("p"), (F.col("all") - F.col("pos")) - (F.col("seen") - F.col("tp"))
    by = rows.filter("pos > 0").groupBy("r", "pos", "all").agg(
        F.sum(F.when(F.col("seen") > 0, F.col("p") / F.col("pos") * F.col("tp") / F.col("seen"))).alias("pr_auc"),
        F.sum(F.col("p") * (below + own / 2)).alias("pairs"), F.sum(F.when(flagged, F.col("p")).otherwise(0.0)).alias("hit"), F.sum(F.when(flagged, F.col("n")).otherwise(0.0)).alias("said"),
    )
    negatives = F.col("all") - F.col("pos")
    found = by.select(
        "r", "pr_auc", F.when(negatives > 0, F.col("pairs") / (F.col("pos") * negatives)).alias("roc_auc"), (2 * F.col("hit") / (F.col("said") + F.col("pos"))).alias("f1"))
    return _intervals(found, ["pr_auc", "roc_auc", "f1"])


def matching(pairs: DataFrame, threshold: float, query: str = "query_id", replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """(metric, estimate, low, high) of pair precision, recall, F1, the missed and the false match rate, queries drawn with replacement.

    pairs: (query_id, score, gold). Rates without anything to divide by are 0.
    """
    hit = F.col("score") >= threshold
    by_query = pairs.groupBy(query).agg(
        F.count_if(hit & F.col("gold")).alias("tp"), F.count_if(hit & ~F.col("gold")).alias("fp"), F.count_if(~hit & F.col("gold")).alias("fn"))
    rows = by_query.select(F.xxhash64(query, F.lit(seed)).alias("c"), "tp", "fp", "fn", (F.col("fp") > 0).cast("long").alias("false_query"), F.lit(1).cast("long").alias("queries"))
    names = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates + 1, len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                c, *values = (col.to_numpy(zero_copy_only=False) for col in batch.slice(at, 2_000).columns)
                total += draws(c, replicates).T @ np.array(values, float).T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates + 1), pa.int32()), *[pa.array(x.copy()) for x in total.T]], names=["r", *names])

    sums = rows.mapInArrow(run, "r int, " + ", ".join(f"{n} double" for n in names)).groupBy("r").agg(*[F.sum(n).alias(n) for n in names])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    metrics = {
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn),
        "missed_match_rate": share(fn, tp + fn), "false_match_rate": share(F.col("false_query"), F.col("queries")),
    }
    return _intervals(sums.filter("queries > 0").select("r", *[v.alias(k) for k, v in metrics.items()]), list(metrics))


def candidate_recall(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """One row over the queries of gold (query_id, doc_id): the share with any gold candidate, and the share of gold pairs found.

    ranked: (query_id, doc_id), the candidates of each query.
    """
    pairs = gold.select("query_id", "doc_id").distinct()
    met = pairs.join(ranked.select("query_id", "doc_id", F.lit(1).alias("met")).distinct(), ["query_id", "doc_id"], "left")
    by_query = met.groupBy("query_id").agg(F.count("met").alias("found"), F.count(F.lit(1)).alias("n"))
    return by_query.agg(
        F.coalesce(F.avg((F.col("found") > 0).cast("double")), F.lit(0.0)).alias("candidate_recall_any"),
        F.coalesce(F.sum("found") / F.sum("n"), F.lit(0.0)).alias("candidate_recall_pairs"))


def separation(ranked: DataFrame, answerable: Column, score: str = "score") -> DataFrame:
    """One row: how well the first score of a query tells those with an answer from those without, as ROC-AUC; null if one kind is missing.

    ranked: (query_id, rank, score) and what `answerable` reads.
    """
    from . import metrics

    firsts = ranked.filter("rank = 1").select(F.col(score).alias("score"), answerable.cast("int").alias("label")).filter("score IS NOT NULL AND label IS NOT NULL")
    return metrics.roc_auc(metrics.curve(firsts)).withColumnRenamed("roc_auc", "separation")
