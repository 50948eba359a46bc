"""BM25 from the written index against brute force: blocks, bounds, ties, filled lists, nulls."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkcase.operators import wordindex


def brute(queries, documents, k=None, places=6, fill=False):
    docs = [(i, [t for t in (tokens or []) if t is not None], len(tokens or [])) for i, tokens in documents]
    n, avgdl = len(docs), sum(length for *_, length in docs) / max(len(docs), 1)
    df = Counter(t for _, tokens, _ in docs for t in set(tokens))
    out = {}
    for q, tokens in queries:
        found = []
        for i, held, length in docs:
            tf, score, hit = Counter(held), 0.0, False
            for t in {t for t in tokens or [] if t is not None}:
                if tf[t]:
                    hit = True
                    score += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * length / avgdl))
            if hit or fill:
                found.append((i, score))
        found.sort(key=lambda x: (-round(x[1], places), x[0]))
        out[q] = found[:k]
    return out


def data(spark, seed, n=400):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(3000)]
    documents = [(i, [rng.choice(words) for _ in range(rng.randint(0, 30))]) for i in range(n)] + [(n, None), (n + 1, ["rare", None, "w1"]), (n + 2, ["rare", "w1", "w1"])]
    queries = [(q, [rng.choice(words) for _ in range(rng.randint(1, 6))]) for q in range(25)] + [(90, ["rare"]), (91, ["never"]), (92, []), (93, None), (94, ["rare", "rare", None])]
    docs = spark.createDataFrame(documents, "doc_id long, tokens array<string>").repartition(3)
    return queries, documents, spark.createDataFrame(queries, "query_id long, tokens array<string>"), docs


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["bm25"]))
    return out


def same(found, want):
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    for q, x in found.items():
        assert [s for _, s in x] == pytest.approx([s for _, s in want[q]], abs=1e-9)


@pytest.mark.parametrize("block_docs,block_tokens", [(16, 10_000), (1_000, 60), (1, 1), (5_000, 500_000)])
def test_best_equals_brute_force(spark, block_docs, block_tokens):
    queries, documents, asks, docs = data(spark, 1)
    index = wordindex.build(docs, block_docs, block_tokens)
    same(lists(wordindex.best(asks, index, 7).collect()), brute(queries, documents, 7))


@pytest.mark.parametrize("k", [3, 50])
def test_filled_lists_hold_k_documents(spark, k):
    queries, documents, asks, docs = data(spark, 2, 120)
    index = wordindex.build(docs, 20)
    found = lists(wordindex.best(asks, index, k, fill=True).collect())
    same(found, brute(queries, documents, k, fill=True))
    assert set(found) == {q for q, _ in queries} and all(len(x) == k for x in found.values())


def test_all_scores(spark):
    queries, documents, asks, docs = data(spark, 3)
    found = {(r["query_id"], r["doc_id"]): r["bm25"] for r in wordindex.scores(asks, wordindex.build(docs, 32)).collect()}
    want = {(q, i): s for q, x in brute(queries, documents).items() for i, s in x}
    assert found.keys() == want.keys() and all(found[key] == pytest.approx(want[key]) for key in want)


def test_bounds_leave_blocks_out(spark):
    """Blocks of one kind of documents: only those of the query's kind can reach the floor, and only they are scored later."""
    documents = [(i, ["common"] * (1 + i // 100) + [f"kind{i // 100}"] * 5 + ["x"] * (i % 7)) for i in range(1000)]
    docs = spark.createDataFrame(documents, "doc_id long, tokens array<string>").coalesce(1)
    asks = spark.createDataFrame([(0, ["common", "kind3"])], "query_id long, tokens array<string>")
    index = wordindex.build(docs, 50)
    same(lists(wordindex.best(asks, index, 5).collect()), brute([(0, ["common", "kind3"])], documents, 5))
    weights = wordindex._weights(wordindex.wanted(asks), index)
    pairs = wordindex._pairs(weights, index, wordindex.K1, wordindex.B)
    floor = wordindex.best(asks, index, 5).agg(F.min("bm25")).first()[0]
    assert pairs.count() == 20 and pairs.filter(F.col("bound") >= floor).count() == 2
    top = {r["block"] & 0xFFFFFF: r["bound"] for r in pairs.collect()}
    scored = wordindex.scores(asks, index).collect()
    for r in scored:
        assert r["bm25"] <= top[r["doc_id"] // 50] + 1e-9


def test_ids_may_be_structs_and_tables_empty(spark):
    docs = spark.createDataFrame([((1, "a"), ["x", "y"]), ((2, None), ["x"])], "doc_id struct<id: long, name: string>, tokens array<string>")
    asks = spark.createDataFrame([("q", ["x"])], "query_id string, tokens array<string>")
    found = wordindex.best(asks, wordindex.build(docs), 2).collect()
    assert [(r["doc_id"]["id"], r["rank"]) for r in found] == [(2, 1), (1, 2)]
    assert wordindex.best(asks, wordindex.build(docs.limit(0)), 2, fill=True).collect() == []
    assert wordindex.best(asks.limit(0), wordindex.build(docs), 2, fill=True).collect() == []


@pytest.mark.parametrize("fill", [False, True])
def test_best_over_groups_and_parts(spark, monkeypatch, fill):
    """Two rounds over many groups, queries in parts, queries of the same terms, one of which names a term twice."""
    for name, value in (("GROUP_DOCS", 30), ("GROUP_QUERIES", 4), ("GROUP_TERMS", 20)):
        monkeypatch.setattr(wordindex, name, value)
    queries, documents, _, docs = data(spark, 4)
    queries += [(200 + q, list(reversed(tokens or [])) + (tokens or [])[:1]) for q, tokens in queries]
    asks = spark.createDataFrame(queries, "query_id long, tokens array<string>")
    same(lists(wordindex.best(asks, wordindex.build(docs, 8), 9, fill=fill).collect()), brute(queries, documents, 9, fill=fill))


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_sent_do_not_grow_with_blocks_times_queries(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, [f"w{rng.randrange(60)}" for _ in range(20)]) for i in range(600)], "doc_id long, tokens array<string>").repartition(2)
    asks = spark.createDataFrame([(q, [f"w{rng.randrange(60)}" for _ in range(3)]) for q in range(2_100)], "query_id long, tokens array<string>")
    index = wordindex.build(docs, 4)
    held, before = index.rows.count(), shuffled(spark)
    found = wordindex.best(asks, index, 5, fill=True).collect()
    assert len(found) == 2_100 * 5
    sent = shuffled(spark) - before
    assert sent < 4 * held + 5 * len(found)  # 150 blocks and 2,100 queries: 315,000 pairs
