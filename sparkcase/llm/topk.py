"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are integer components. A block of vectors is indexed by posting
segments: for each dimension and each (quantised) value, the vectors that have
it. A query's impact on a segment is its component times that value, less the
least such product of the dimension, so impacts are never negative. Segments
are processed in rounds of descending impact. After each round

- a vector's bound is the sum of its processed impacts and, in each dimension
  where it has not been seen, of the next impact or the dimension's largest one,
  whichever is less, and
- the exact scores of the leading vectors give a proven lower bound of the k-th
  score.

A vector whose bound is below the k-th score is out, and later rounds leave it
alone. Once few possible members remain (ties included) the rest of the segments
is skipped on that proof and the members are rescored exactly. Rounds never end
otherwise: with all segments processed the bound is the score itself.

A round adds many segments at once, so the index keeps, in place of lists, each
vector's segment in every dimension, and a round looks up their gains.

Vectors are dealt out by hash over blocks of about BLOCK_VECTORS, queries over
blocks of about BLOCK_QUERIES; every query block meets every index block, and
the partial results are merged per query. An index takes two bytes a component.

Rows whose id or vector is null, or whose vector holds a null or non-finite
component (or one of 2**57 or more), take no part. Equal rows count once. Shorter vectors count as padded
with zeros. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

K = 20
SCALE = 64.0
BLOCK_VECTORS = 16_384
BLOCK_QUERIES = 2_048
#: Shares of the postings after which the bounds are looked at.
CHECKS = (0.6, 0.7, 0.8, 0.9, 1.0)
#: Indexes of vectors with larger components hold Python integers and skip nothing.
EXACT_BITS = 25


class ImpactIndex:
    """The posting segments of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that ties go to smaller ids
        self.ids, vectors = ids[order], vectors[order]
        n, width = vectors.shape
        # Sums of up to width impacts of two components, and differences of them, are exact in doubles below it.
        self.limit = (1 << EXACT_BITS) // max(width, 1)
        self.wide = bool(np.abs(vectors).max(initial=0) > self.limit)
        if self.wide:
            self.vectors = vectors
            return
        values, self.n_segments, self.codes = [], [], np.zeros((width, n), np.int16 if n < 1 << 15 else np.int32)
        for d in range(width):
            found, code = np.unique(vectors[:, d], return_inverse=True)
            self.codes[d] = code
            values.append(found)
            self.n_segments.append(len(found))
        self.values = np.concatenate([np.zeros(0, np.int64), *values])

    @cached_property
    def first(self) -> np.ndarray:
        """The first segment of each dimension, and the number of all."""
        return np.concatenate(([0], np.cumsum(self.n_segments))).astype(np.int64)

    @cached_property
    def dims(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_segments)), self.n_segments)

    @cached_property
    def sizes(self) -> np.ndarray:
        """The number of vectors in each segment."""
        return np.concatenate([np.zeros(0, np.int64), *(np.bincount(c, minlength=k) for c, k in zip(self.codes, self.n_segments))])

    @cached_property
    def places(self) -> np.ndarray:
        """Each vector's segment in each dimension."""
        return self.codes.astype(np.intp) + self.first[:-1, None]

    @cached_property
    def doubles(self) -> np.ndarray:
        return np.ascontiguousarray(self.values.astype(np.float64)[self.places].T)

    def search(self, query: np.ndarray, query_id, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(positions, scores) of the k best, the query's own id left out, and the share of the postings processed."""
        alive = np.flatnonzero(self.ids != query_id)
        if self.wide or (len(query) and max(abs(int(x)) for x in query) > self.limit):
            vectors = self.vectors if self.wide else self.values[self.places].T
            scores = np.array([sum(int(a) * int(b) for a, b in zip(query, vectors[i])) for i in alive], object)
            return *self._best(alive, scores, k), 1.0
        width, n = self.codes.shape
        q, done = query.astype(np.float64), 0.0
        if width and n:
            products = q[self.dims] * self.values
            least = np.minimum.reduceat(products, self.first[:-1])
            impacts = products - least[self.dims]
            most = np.maximum.reduceat(impacts, self.first[:-1])[self.dims]
            order = np.argsort(-impacts, kind="stable")
            upto, floor = np.cumsum(self.sizes[order]), -np.inf
            places, base = self.places[:, alive] if len(alive) < n - 1 else self.places, float(least.sum())
            whole = places is self.places  # the query's own column is masked below
            for share in CHECKS:
                end = int(np.searchsorted(upto, share * upto[-1], side="right"))
                following = float(impacts[order[end]]) if end < len(order) else 0.0
                # What a segment adds to a bound: its impact once it is processed, before that the most an unseen one can add.
                gain = np.maximum(impacts, np.minimum(following, most))
                bound = np.full(places.shape[1], base)
                for row in places:
                    bound += gain.take(row)
                if whole:
                    bound, whole = bound[alive], False
                done = float(upto[end - 1] / upto[-1]) if end else 0.0
                lead = alive[np.argpartition(-bound, 4 * k)[: 4 * k + 1]] if len(alive) > 4 * k + 1 else alive
                exact = self.doubles[lead] @ q
                if len(exact) >= k:
                    floor = max(floor, float(np.partition(exact, len(exact) - k)[len(exact) - k]))
                alive = alive[bound >= floor]
                if len(alive) <= max(8 * k, n // 8):  # the proof leaves only these
                    break
                places = self.places[:, alive]
        return *self._best(alive, self.doubles[alive] @ q, k), done

    @staticmethod
    def _best(members: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.lexsort((members, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(members)), key=lambda i: (-scores[i], members[i]))[:k], int)
        return members[best], scores[best]


def quantised(vector: Column, scale: float = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float(2**57)), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def top_k(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "v", k: int = K) -> DataFrame:
    """(query_id, rank, id, score): for each row where queries holds, the k best other rows of df.

    df's vectors are arrays of longs; a row of the query's id is never its candidate.
    """
    rows = written(df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), queries.alias("asks")).distinct(), "vectors")
    counts = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
    blocks, query_blocks, width = -(-counts[0] // BLOCK_VECTORS), -(-counts[1] // BLOCK_QUERIES), counts[2] or 0
    id_type = rows.schema["id"].dataType.simpleString()

    def matrix(vectors: pd.Series) -> np.ndarray:
        out = np.zeros((len(vectors), width), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def index(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        built = ImpactIndex(part["id"].to_numpy(), matrix(part["v"]))
        return pd.DataFrame({"block": [key[0]], "index": [pickle.dumps(built)]})

    def search(key: tuple, asked: pd.DataFrame, indexed: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(indexed):
            built: ImpactIndex = pickle.loads(indexed["index"].iloc[0])
            for query_id, query in zip(asked["id"], matrix(asked["v"])):
                at, scores, _ = built.search(query, query_id, k)
                out += [(query_id, built.ids[i], int(s)) for i, s in zip(at, scores)]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    def grid(of: DataFrame, col: str, n: int) -> DataFrame:
        return of.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))))

    block = F.pmod(F.xxhash64("id", "v"), F.lit(max(blocks, 1))).cast("int")
    indexes = written(rows.select("id", "v", block.alias("block")).groupBy("block").applyInPandas(index, "block int, index binary"), "impacts")
    query_block = F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(max(query_blocks, 1))).cast("int")
    asking = grid(rows.filter("asks").select("id", "v", query_block.alias("query_block")), "block", blocks)
    found = asking.groupBy("block", "query_block").cogroup(
        grid(indexes, "query_block", query_blocks).groupBy("block", "query_block")
    ).applyInPandas(search, f"query_id {id_type}, id {id_type}, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op1_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")))
    return top_k(vectors.select("vec_id", quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 20 == 0)
