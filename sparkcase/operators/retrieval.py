"""BM25, dense and fused retrieval as joins and aggregates.

documents: (doc_id, tokens array), or their WordIndex; queries: (query_id, tokens
array). Words are looked up in a written index over blocks of documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import dot
from . import wordindex
from .wordindex import B, K1, WordIndex, idf

RRF_K = 60


def bm25(queries: DataFrame, documents: DataFrame | WordIndex) -> DataFrame:
    """(query_id, doc_id, bm25): each query's distinct terms count once; documents without a shared term are absent."""
    return wordindex.scores(queries, _index(documents))


def _index(documents: DataFrame | WordIndex) -> WordIndex:
    return documents if isinstance(documents, WordIndex) else wordindex.build(documents)


def ceilings(queries: DataFrame, documents: DataFrame | WordIndex, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, ceiling): the score of a document that equals the query; repeated terms count by their number, unseen ones too."""
    index = _index(documents)
    own = queries.select("query_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    own = own.groupBy("query_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    own = own.join(index.frequencies(own.select("term").distinct()), "term", "left").fillna(0, ["df"])
    tf = F.col("tf")
    weight = idf(F.lit(int(index.stats["n"])), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(index.stats["avgdl"])))
    return own.groupBy("query_id").agg(F.sum(weight).alias("ceiling"))


def normalised(scores: DataFrame, tops: DataFrame) -> DataFrame:
    share = F.when(F.col("ceiling") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("bm25") / F.col("ceiling")))).otherwise(0.0)
    return scores.join(tops, "query_id").withColumn("bm25_share", share).drop("ceiling")


#: Vectors of a block, and queries that meet it at once, about.
BLOCK_VECTORS, BLOCK_QUERIES = 20_000, 2_000


def _in_blocks(queries: DataFrame, documents: DataFrame, blocks: int | None, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Documents dealt out over blocks by hash, and the stated queries, in parts, repeated for each block.

    The number of blocks and parts follows the rows, so that no group grows with the tables.
    """
    if blocks is None:
        blocks = max(-(-documents.count() // BLOCK_VECTORS), 1)
    parts = max(-(-queries.count() // BLOCK_QUERIES), 1)
    d = documents.select("doc_id", "vector", *more, F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    q = queries.select(
        "query_id", F.col("vector").alias("q"), *[F.col(c).alias(f"q_{c}") for c in more], F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return q, d.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def dense(queries: DataFrame, documents: DataFrame, blocks: int | None = None) -> DataFrame:
    """(query_id, doc_id, dense): the exact product of every stated query with every document, block by block."""
    q, d = _in_blocks(queries, documents, blocks)
    return d.join(q, ["block", "part"]).select("query_id", "doc_id", dot(F.col("q"), F.col("vector")).alias("dense"))


def nearest(queries: DataFrame, documents: DataFrame, k: int, blocks: int | None = None, places: int = 9, clip: bool = False, within: str | None = None) -> DataFrame:
    """(query_id, doc_id, dense, rank): the k best documents of each stated query, itself left out.

    clip: scores below 0 count as 0. within: only documents that have the query's value in this column count.

    Each block yields k rows a query at most, from one matrix product, so what
    is shuffled to be merged grows with queries, not with pairs. Scores that
    are equal in `places` decimals are ordered by doc_id.
    """
    q, d = _in_blocks(queries, documents, blocks, (within,) if within else ())
    kind = {c: t for c, t in [*q.dtypes, *d.dtypes]}

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("doc_id", kind="stable")
            ids = held["doc_id"].to_numpy()
            matrix = np.stack([np.asarray(v, np.float64) for v in held["vector"]])
            kinds = held[within].to_numpy() if within else None
            for query_id, vector, own in zip(asked["query_id"], asked["q"], asked[f"q_{within}"] if within else asked["query_id"]):
                scores = matrix @ np.asarray(vector, np.float64)
                scores = np.maximum(scores, 0.0) if clip else scores
                among = np.flatnonzero(kinds == own) if within else np.arange(len(ids))
                order = among[np.argsort(-np.round(scores[among], places), kind="stable")[: k + 1]]
                out += [(query_id, ids[i], float(scores[i])) for i in order if ids[i] != query_id]
        return pd.DataFrame(out, columns=["query_id", "doc_id", "dense"])

    found = q.groupBy("block", "part").cogroup(d.groupBy("block", "part")).applyInPandas(best, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, dense double")
    return ranked(found.withColumn("s", F.round("dense", places)), "s", k).drop("s")


def ranked(scores: DataFrame, score: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best of each query, ties by doc_id; Spark drops the rest before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return scores.withColumn(rank, F.row_number().over(best)).filter(F.col(rank) <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, rrf, rank) of ranked lists (query_id, doc_id, rank)."""
    every = lists[0].select("query_id", "doc_id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("query_id", "doc_id", "rank"))
    fused = every.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("rrf"))
    return ranked(fused, "rrf", k)


def search(queries: DataFrame, documents: DataFrame, k: int = 5, pool: int = 30, untrusted: bool = False) -> DataFrame:
    """Hybrid retrieval with component scores. documents: doc_id, tokens, vector, trust; the trust filter comes before ranking."""
    allowed = documents if untrusted else documents.filter(F.col("trust") == "trusted")
    index = wordindex.build(allowed)
    words = wordindex.best(queries, index, pool)
    near = nearest(queries, allowed, max(k, pool))
    fused = reciprocal_rank_fusion([words, near], k)
    # The vectors of what the words alone have found are fetched late, for these few rows.
    vectors = allowed.select("doc_id", "vector").join(fused.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = fused.join(vectors, "doc_id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    scored = scored.withColumn("dense", dot(F.col("q"), F.col("vector"))).drop("q", "vector")
    # What the vectors alone have found gets its own score by words too.
    return scored.join(bm25(queries, index), ["query_id", "doc_id"], "left").fillna(0.0, ["bm25"])


def first_seen(results: DataFrame, most: int = 4) -> DataFrame:
    """(case_id, doc_id, place): at most so many documents a case, in the order in which its queries (query_index, rank) bring them up."""
    seen = results.groupBy("case_id", "doc_id").agg(F.min(F.struct("query_index", "rank")).alias("at"))
    order = Window.partitionBy("case_id").orderBy("at", "doc_id")
    return seen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("case_id", "doc_id", "place")


def fetched(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of these ids (doc_id), each once."""
    return documents.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def stored(documents: DataFrame) -> DataFrame:
    """One row: how many documents the store holds, and how many it may show by default."""
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("trust") == "trusted").alias("trusted"))
