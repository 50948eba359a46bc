"""Ranking, detection and agreement metrics as aggregates.

Curves are made on aggregated ties: scores are first counted per distinct value,
so that the one ordered pass sees distinct scores, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def curve(df: DataFrame, score: str = "score", label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct score, from high to low: tp and fp at or above it, and the totals.

    Scores are laid into BUCKETS ordered buckets. Only bucket totals are summed
    in one order; within a bucket its own scores are, so no task orders all.
    """
    at = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    ends = df.groupBy(*keys).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    at = at.join(ends, list(keys)) if keys else at.join(F.broadcast(ends))  # without keys, one row
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS)).otherwise(0)
    at = at.withColumn("bucket", F.coalesce(place, F.lit(0)).cast("int")).drop("lo", "hi")
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    totals = at.groupBy(*keys, "bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn")).select(
        *keys, "bucket", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"),
        F.sum("bp").over(every).alias("positives"), F.sum("bn").over(every).alias("rows"),
    )
    down = Window.partitionBy(*keys, "bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    rows = at.withColumns({"tp1": F.sum("p").over(down), "n1": F.sum("n").over(down)}).join(totals, [*keys, "bucket"])
    rows = rows.withColumns({"tp": F.col("tp0") + F.col("tp1"), "seen": F.col("n0") + F.col("n1")}).drop("tp0", "tp1", "n0", "n1", "bucket")
    return rows.withColumn("fp", F.col("seen") - F.col("tp"))


def average_precision(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Step sum of precision over recall gains; not a trapezoid."""
    return points.groupBy(*keys).agg(F.coalesce(F.sum(F.col("p") / F.col("positives") * F.col("tp") / F.col("seen")), F.lit(0.0)).alias("average_precision"))


def roc_auc(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of pairs in order, ties as half."""
    negatives = F.col("rows") - F.col("positives")
    own = F.col("n") - F.col("p")
    below = negatives - F.col("fp")
    return points.groupBy(*keys).agg(F.sum(F.col("p") * (below + own / 2.0) / (F.col("positives") * negatives)).alias("roc_auc"))


def f1_threshold(points: DataFrame, score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """The lowest score whose F1 is best when it and above count as positive."""
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("seen") + F.col("positives"))).otherwise(0.0)
    return points.withColumn("f1", f1).groupBy(*keys).agg(F.max_by(score, F.struct("f1", (-F.col(score)).alias("low"))).alias("threshold"), F.max("f1").alias("f1"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def operating_point(df: DataFrame, threshold: Column, score: str = "score", label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """precision, recall, f1, fpr, fnr and flagged share at a threshold (inclusive)."""
    flag, real = F.col(score) >= threshold, F.col(label).cast("boolean")
    c = df.groupBy(*keys).agg(
        F.count_if(flag & real).alias("tp"), F.count_if(flag & ~real).alias("fp"), F.count_if(~flag & real).alias("fn"), F.count_if(~flag & ~real).alias("tn"))
    return c.select(*keys, *rates(), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), ratio(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"),
                    ratio(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("share"))


def rates() -> list[Column]:
    """precision, recall and f1 of columns tp, fp, fn; 0 on nothing."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def at_budget(df: DataFrame, shares: tuple[float, ...], score: str = "score", label: str = "label", tie: str = "id") -> DataFrame:
    """Precision and recall of the round(share * n), at least 1, best rows.

    The cut is found on counts per score; only the score at the cut is ordered by its tie-break.
    """
    points = curve(df, score, label).select(F.col(score).alias("s"), "seen", "n", "rows", "positives")
    budgets = df.sparkSession.createDataFrame([(float(s),) for s in shares], "budget double")
    size = F.greatest(F.lit(1), F.bround(F.col("budget") * F.col("rows")).cast("long"))
    cut = points.join(F.broadcast(budgets)).withColumn("size", size).filter((F.col("seen") >= F.col("size")) & (F.col("seen") - F.col("n") < F.col("size")))
    cut = cut.select("budget", "s", "size", (F.col("size") - F.col("seen") + F.col("n")).alias("take"), "positives")
    rows = df.join(F.broadcast(cut), F.col(score) >= F.col("s"))
    edge = Window.partitionBy("budget", score).orderBy(tie)
    taken = rows.withColumn("nth", F.when(F.col(score) == F.col("s"), F.row_number().over(edge)).otherwise(0)).filter(F.col("nth") <= F.col("take"))
    return taken.groupBy("budget", "size", "positives").agg(F.sum(F.col(label).cast("long")).alias("tp")).select(
        "budget", "size", (F.col("tp") / F.col("size")).alias("precision"), ratio(F.col("tp"), F.col("positives")).alias("recall"))


def recall_by(df: DataFrame, kind: str, flag: str) -> DataFrame:
    return df.filter(F.col(kind) != "none").groupBy(kind).agg(F.avg(F.col(flag).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def matching(pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs (query_id, score, gold): P, R, F1 of pairs, and the share of queries with a false match."""
    hit = F.col("score") >= threshold
    by_query = pairs.groupBy("query_id").agg(F.count_if(hit & F.col("gold")).alias("tp"), F.count_if(hit & ~F.col("gold")).alias("fp"), F.count_if(~hit & F.col("gold")).alias("fn"))
    total = by_query.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg((F.col("fp") > 0).cast("double")).alias("false_match"))
    return total.select(*rates(), "false_match")


def best_grid_threshold(pairs: DataFrame, steps: int = 201) -> DataFrame:
    """The strictest of the thresholds 0..1 with the best F1; scores are binned, so no row meets every threshold."""
    last = steps - 1
    bins = pairs.withColumn("bin", F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * last + 1e-9)).groupBy("bin").agg(
        F.count_if("gold").alias("p"), F.count(F.lit(1)).alias("n"))
    grid = pairs.sparkSession.range(steps).select(F.col("id").alias("bin")).join(bins, "bin", "left").fillna(0)
    up = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # `steps` rows
    total = Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = grid.withColumns({"tp": F.sum("p").over(up), "seen": F.sum("n").over(up), "positives": F.sum("p").over(total)})
    f1 = ratio(2.0 * F.col("tp"), F.col("seen") + F.col("positives"))
    return rows.withColumn("f1", f1).agg(F.max_by("bin", F.struct("f1", "bin")).alias("bin"), F.max("f1").alias("f1")).select((F.col("bin") / float(last)).alias("threshold"), "f1")


def ranking(ranked: DataFrame, k: int = 5) -> DataFrame:
    """ranked (query_id, rank, gold): mean reciprocal rank, top-1, hit@k and nDCG@k (each gold once) over queries."""
    first = F.min(F.when(F.col("gold"), F.col("rank")))
    gain = F.sum(F.when(F.col("gold") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    by = ranked.groupBy("query_id").agg(first.alias("first"), gain.alias("dcg"), F.count_if("gold").alias("n_gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_gold"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return by.agg(
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0))).alias("top1"),
        F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias("hit"), F.avg(F.when(F.col("n_gold") > 0, F.col("dcg") / ideal).otherwise(0.0)).alias("ndcg"))


def bootstrap(df: DataFrame, cluster: str, value: Column, replicates: int = 200, seed: int = 1) -> DataFrame:
    """95 % interval of a mean by a Poisson bootstrap over clusters: weights are hashes, so any partitioning gives the same.

    Clusters are summed first; each is then weighted once a replicate.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"))
    rows = sums.select("v", "n", F.col(cluster), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r"))
    u = (F.pmod(F.xxhash64(cluster, "r", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        steps.append(F.when(u > total, 1).otherwise(0))
        p /= k + 1
    weighted = rows.withColumn("w", sum(steps[1:], steps[0])).groupBy("r").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum(F.col("n") * F.col("w"))).alias("mean"))
    return weighted.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def set_comparison(truth: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """tp, fp, fn and rates of a predicted set of keys."""
    both = truth.select(*key, F.lit(True).alias("real")).distinct().join(predicted.select(*key, F.lit(True).alias("said")).distinct(), key, "full")
    c = both.agg(F.count_if(F.col("real") & F.col("said")).alias("tp"), F.count_if(F.col("real").isNull()).alias("fp"), F.count_if(F.col("said").isNull()).alias("fn"))
    return c.select("tp", "fp", "fn", *rates())


def paired_effect(runs: DataFrame) -> DataFrame:
    """runs (case_id, paired_with, decision): of injected runs and their controls, how many changed and how many became CLEAR."""
    control = runs.filter("paired_with is null").select(F.col("case_id").alias("paired_with"), F.col("decision").alias("before"))
    both = runs.filter("paired_with is not null").join(control, "paired_with")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("decision") != F.col("before")).alias("changed"),
                    F.count_if((F.col("decision") == "CLEAR") & (F.col("before") != "CLEAR")).alias("cleared"))


def composition(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of every combination of these columns, with totals (null) over each of them."""
    return rows.cube(*by).agg(F.count(F.lit(1)).alias("n"))


def matching_by_slice(pairs: DataFrame, threshold: float, slice_: str = "slice") -> DataFrame:
    """Precision and recall of pairs (score, gold) by slice; an array of slices counts in each."""
    rows = pairs.withColumn(slice_, F.explode(slice_)) if pairs.schema[slice_].dataType.typeName() == "array" else pairs
    said = F.col("score") >= threshold
    out = rows.groupBy(slice_).agg(F.count_if(said & F.col("gold")).alias("tp"), F.count_if(said & ~F.col("gold")).alias("fp"), F.count_if(~said & F.col("gold")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return out.select(slice_, ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def poisoning_exposure(results: DataFrame, k: int = 5) -> DataFrame:
    """One row over queries that have a poison document: how often it is among the first k, and above the first gold one.

    results: (query_id, rank, kind), kind being gold, poison or other; ranks that are missing stand behind all others.
    """
    best = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("rank")))
    by_query = results.groupBy("query_id").agg(best("poison").alias("poison"), best("gold").alias("gold"), F.max((F.col("kind") == "poison").cast("int")).alias("has"))
    return by_query.filter("has = 1").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("poison") <= k).alias("exposed"),
        F.count_if((F.col("poison") <= k) & (F.col("gold").isNull() | (F.col("poison") < F.col("gold")))).alias("above_gold"),
    )


def paired_wins(scores: DataFrame, first: str, second: str) -> DataFrame:
    """One row: in how many cases (case_id, system, score) the first system scores above, below or like the second."""
    of = lambda name: F.max(F.when(F.col("system") == name, F.col("score")))
    by_case = scores.groupBy("case_id").agg(of(first).alias("a"), of(second).alias("b")).filter("a is not null and b is not null")
    return by_case.agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))
