"""Bootstrap intervals: the same weights by brute force, coverage of known values, ties, nulls, and candidate recall."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcase.operators import bootstraps


def weighted(y, s, w, threshold):
    """PR-AUC as a step sum over distinct scores, ROC-AUC over pairs, F1."""
    p, n = w[y].sum(), w[~y].sum()
    if not p:
        return None
    ap = tp = seen = 0.0
    for v in np.unique(s)[::-1]:
        here = w[(s == v) & y].sum()
        tp, seen = tp + here, seen + w[s == v].sum()
        ap += here / p * tp / seen if seen else 0
    pairs = sum(a * (w[~y & (s < v)].sum() + w[~y & (s == v)].sum() / 2) for v, a in zip(s[y], w[y]))
    flagged = s >= threshold
    return ap, pairs / (p * n) if n else None, 2 * w[flagged & y].sum() / (w[flagged].sum() + p)


@pytest.mark.parametrize("ties", [True, False])
def test_curves_equal_brute_force(spark, ties):
    rng = np.random.default_rng(3)
    clusters = rng.integers(0, 30, 400)
    y = rng.random(400) < 0.2
    s = np.round(rng.normal(size=400) + y, 1 if ties else 9)
    df = spark.createDataFrame([(int(c), float(a), bool(b)) for c, a, b in zip(clusters, s, y)] + [(1, None, True), (2, 0.5, None)], "cluster long, score double, label boolean").repartition(3)
    found = {r["metric"]: r for r in bootstraps.curves(df, 0.7, replicates=60).collect()}
    ids = {r["cluster"]: r["h"] for r in df.select("cluster", F.xxhash64("cluster", F.lit(1)).alias("h")).distinct().collect()}
    w = bootstraps.draws(np.array([ids[int(c)] for c in clusters]), 60)
    every = [weighted(y, s, w[:, r].astype(float), 0.7) for r in range(61)]
    for i, name in enumerate(("pr_auc", "roc_auc", "f1")):
        again = [e[i] for e in every[1:] if e is not None and e[i] is not None]
        assert found[name]["estimate"] == pytest.approx(every[0][i])
        assert (found[name]["low"], found[name]["high"]) == pytest.approx((np.percentile(again, 2.5), np.percentile(again, 97.5)))


def test_many_scores_in_equal_bins_stay_near(spark):
    rng = np.random.default_rng(4)
    y = rng.random(5000) < 0.3
    s = rng.normal(size=5000) + 1.5 * y
    df = spark.createDataFrame([(i % 500, float(a), bool(b)) for i, (a, b) in enumerate(zip(s, y))], "cluster long, score double, label boolean")
    found = {r["metric"]: r for r in bootstraps.curves(df, 1.0, replicates=40, bins=256).collect()}
    exact = weighted(y, s, np.ones(5000), 1.0)
    assert found["pr_auc"]["estimate"] == pytest.approx(exact[0], abs=0.01) and found["roc_auc"]["estimate"] == pytest.approx(exact[1], abs=0.002)
    assert found["f1"]["estimate"] == pytest.approx(exact[2])
    assert all(r["low"] < r["estimate"] < r["high"] for r in found.values())


def test_intervals_cover_what_is_known(spark):
    """Of 40 samples of a population whose ROC-AUC is known, most 95 % intervals hold it."""
    from statistics import NormalDist

    true, rng, held = NormalDist().cdf(1 / 2**0.5), np.random.default_rng(5), 0
    for trial in range(15):
        y = rng.random(300) < 0.4
        rows = [(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(rng.normal(size=300) + y, y))]
        r = bootstraps.curves(spark.createDataFrame(rows, "cluster long, score double, label boolean").coalesce(1), 0.5, seed=trial).filter("metric = 'roc_auc'").first()
        held += r["low"] <= true <= r["high"]
    assert held >= 11


def test_draws_are_poisson_and_clusters_whole():
    w = bootstraps.draws(np.arange(-2000, 2000), 50)
    assert (w[:, 0] == 1).all() and w[:, 1:].mean() == pytest.approx(1, abs=0.01) and w[:, 1:].var() == pytest.approx(1, abs=0.03)
    assert (bootstraps.draws(np.array([5, 5]), 50)[0] == bootstraps.draws(np.array([5]), 50)[0]).all()


def test_matching_intervals(spark):
    rng = random.Random(6)
    pairs = [(q, rng.random(), rng.random() < 0.4) for q in range(60) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(pairs, "query_id long, score double, gold boolean").repartition(4)
    found = {r["metric"]: r for r in bootstraps.matching(df, 0.5, replicates=30).collect()}
    by = {q: [0, 0, 0] for q, *_ in pairs}
    for q, s, g in pairs:
        by[q][0 if s >= 0.5 and g else 1 if s >= 0.5 else 2] += s >= 0.5 or g
    ids = {r["query_id"]: r["h"] for r in df.select("query_id", F.xxhash64("query_id", F.lit(1)).alias("h")).distinct().collect()}
    w = bootstraps.draws(np.array([ids[q] for q in by]), 30).astype(float)
    counts = np.array(list(by.values()), float)
    tp, fp, fn = (w.T @ counts).T
    want = {"precision": tp / (tp + fp), "recall": tp / (tp + fn), "f1": 2 * tp / (2 * tp + fp + fn), "missed_match_rate": fn / (tp + fn), "false_match_rate": w.T @ (counts[:, 1] > 0) / w.sum(axis=0)}
    for name, v in want.items():
        assert (found[name]["estimate"], found[name]["low"], found[name]["high"]) == pytest.approx((v[0], np.percentile(v[1:], 2.5), np.percentile(v[1:], 97.5)))


def test_candidate_recall_and_separation(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "d")], "query_id long, doc_id string")
    ranked = spark.createDataFrame([(1, "a", 1, 0.9), (1, "x", 2, 0.8), (2, "x", 1, 0.7), (3, "d", 1, 0.6), (4, "z", 1, 0.65), (5, "z", 1, 0.1)], "query_id long, doc_id string, rank int, score double")
    r = bootstraps.candidate_recall(ranked, gold).first()
    assert (r["candidate_recall_any"], r["candidate_recall_pairs"]) == pytest.approx((2 / 3, 2 / 4))
    assert tuple(bootstraps.candidate_recall(ranked, gold.limit(0)).first()) == (0.0, 0.0)
    assert bootstraps.separation(ranked, F.col("query_id") <= 3).first()[0] == pytest.approx(5 / 6)
