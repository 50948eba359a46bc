"""A written inverted index over blocks of documents, and BM25 from it.

Each task indexes the documents it reads, in blocks, without any shuffle: a row a
term of a block with the places of its documents and their term frequencies, so a
term of most documents is split by block, and a row a block with the documents'
ids and lengths. Statistics are sums over these rows.

The best k documents of each query come in two rounds. Blocks are dealt to groups,
and each group is met by all queries at once, each different set of terms as one
query. The first round scores about the root of the number of groups; its k-th best
score is a floor for the second, which returns only what reaches it, and leaves a
query out where the terms' largest impacts in the group stay below it. That is exact.

A null list of tokens is an empty one; null terms do not count. Documents of one id
are scored each for itself. An empty table or a query without terms finds nothing,
but filled lists then hold the first ids with score 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

K1, B = 1.5, 0.75
#: Documents and tokens of a block, about.
BLOCK_DOCS, BLOCK_TOKENS = 2_048, 500_000
#: Queries that meet a block at once, about.
BLOCK_QUERIES = 2_000
#: Documents and tokens of a group of blocks in which the best documents are searched, and the queries and their terms that
#: meet it at once, about.
GROUP_DOCS, GROUP_TOKENS = 8_192, 4_000_000
GROUP_QUERIES, GROUP_TERMS = 30_000, 300_000
#: Bounds and scores are sums in another order: such a difference is none.
SLACK = 1e-9


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _block_rows(block: int, ids: pa.Array, tokens: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its documents, then its terms."""
    n = len(ids)
    sizes = np.diff(tokens.offsets.to_numpy())
    flat, place = tokens.flatten(), np.repeat(np.arange(n), sizes)
    if flat.null_count:
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        flat, place = flat.filter(pa.array(there)), place[there]
    lengths = sizes.astype(np.int32)
    coded = flat.dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    pairs, tf = np.unique(codes * max(n, 1) + place, return_counts=True)
    term_of, at = pairs // max(n, 1), (pairs % max(n, 1)).astype(np.int32)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(term_of) > 0))) if len(pairs) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate((starts, [len(pairs)])).astype(np.int32))
    none = lambda k, t: pa.nulls(k, t)
    ints, one = pa.list_(pa.int32()), pa.array([0, n], pa.int32())
    yield pa.RecordBatch.from_arrays([
        pa.array([block]), none(1, pa.string()), none(1, pa.int32()), none(1, pa.int32()), none(1, ints), none(1, ints),
        pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, pa.array(lengths)),
    ], names=names)
    k = len(starts)
    if k:
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(k, block)), terms.take(pa.array(term_of[starts])),
            pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)), pa.array(np.minimum.reduceat(lengths[at], starts)),
            pa.ListArray.from_arrays(offsets, pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
            none(k, pa.list_(ids.type)), none(k, ints),
        ], names=names)


@dataclass
class WordIndex:
    """rows: (block, term, most, least, places, tfs) for terms, (block, ids, lengths) for blocks."""

    rows: DataFrame

    @property
    def terms(self) -> DataFrame:
        return self.rows.filter("term IS NOT NULL").select("block", "term", "most", "least", "places", "tfs")

    @property
    def blocks(self) -> DataFrame:
        return self.rows.filter("ids IS NOT NULL").select("block", "ids", "lengths")

    @cached_property
    def stats(self) -> Row:
        """n documents and their mean length."""
        length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
        return self.blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), (F.sum(length) / F.sum(F.size("ids"))).alias("avgdl")).head()

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df) of the terms that occur."""
        return self.terms.select("term", F.size("places").alias("k")).join(terms, "term", "left_semi").groupBy("term").agg(F.sum("k").alias("df"))


def build(documents: DataFrame, block_docs: int = BLOCK_DOCS, block_tokens: int = BLOCK_TOKENS, label: str = "words") -> WordIndex:
    """The index of documents (doc_id, tokens), written to the shared folder once."""
    id_type = documents.schema["doc_id"].dataType
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("term", T.StringType()), T.StructField("most", T.IntegerType()), T.StructField("least", T.IntegerType()),
        T.StructField("places", ints), T.StructField("tfs", ints), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", ints),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, docs, size = TaskContext.get().partitionId() << 24, [], 0, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield from _block_rows(block, whole.column(0), whole.column(1), schema.names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, block_docs - docs)
                sizes = np.cumsum(pc.fill_null(pc.list_value_length(some.column(1)), 0).to_numpy(zero_copy_only=False))
                some = some.slice(0, int(np.searchsorted(sizes, block_tokens - size)) + 1)
                held.append(some)
                at, docs, size = at + some.num_rows, docs + some.num_rows, size + int(sizes[some.num_rows - 1])
                if docs >= block_docs or size >= block_tokens:
                    yield from flushed()
                    block, held, docs, size = block + 1, [], 0, 0
        if docs:
            yield from flushed()

    tokens = F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")
    return WordIndex(written(documents.select("doc_id", tokens).mapInArrow(run, schema), label))


def wanted(queries: DataFrame) -> DataFrame:
    """(query_id, term): each distinct term of a query once."""
    return queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term")).filter("term IS NOT NULL")


def _weights(asked: DataFrame, index: WordIndex) -> DataFrame:
    """(query_id, term, idf) of query terms that occur in the index."""
    df = index.frequencies(asked.select("term").distinct())
    return asked.join(df, "term").select("query_id", "term", idf(F.lit(int(index.stats["n"])), F.col("df")).alias("idf"))


def _impact(tf: Column, length: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(avgdl)))


def _scored(pairs: DataFrame, index: WordIndex, k1: float, b: float, parts: int) -> DataFrame:
    """(query_id, doc_id, bm25) of pairs (block, query_id, terms of (term, idf)): the matching documents of each pair's block.

    Queries meet a block in parts, so no group grows with their number.
    """
    avgdl = index.stats["avgdl"]
    query_type, id_type = pairs.schema["query_id"].dataType, index.rows.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", id_type), T.StructField("bm25", T.DoubleType())])
    used = pairs.select(F.explode("terms.term").alias("term")).distinct()
    rows = index.rows.filter("ids IS NOT NULL").unionByName(index.rows.join(used, "term", "left_semi"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = pairs.select(*[F.col(c).alias(c) for c in ("block", "query_id", "terms")], F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found_q, found_d, found_s, ids = [], [], [], None
        terms = {}
        for row in left.select(["term", "places", "tfs"]).to_batches() if right.num_rows else ():
            places, tfs = row.column(1), row.column(2)
            for i, term in enumerate(row.column(0).to_pylist()):
                if term is not None:
                    terms[term] = (places[i].values.to_numpy(), tfs[i].values.to_numpy().astype(float))
        if right.num_rows and left.num_rows:
            own = left.filter(pc.is_valid(left["ids"])).slice(0, 1)
            ids, lengths = own["ids"][0].values, own["lengths"][0].values.to_numpy()
            norm = k1 * (1 - b + b * lengths / avgdl) if avgdl else None
            terms = {t: (p, tf * (k1 + 1) / (tf + norm[p])) for t, (p, tf) in terms.items()}
            queries = right["query_id"].combine_chunks()
            for i, held in enumerate(right["terms"].to_pylist()):
                scores = np.zeros(len(ids))
                matched = np.zeros(len(ids), bool)
                for t in held:
                    if (got := terms.get(t["term"])) is not None:
                        scores[got[0]] += t["idf"] * got[1]
                        matched[got[0]] = True
                at = np.flatnonzero(matched)
                found_q.append(np.full(len(at), i))
                found_d.append(at)
                found_s.append(scores[at])
        if ids is None or not found_q:
            return pa.Table.from_batches([], pa.schema([("query_id", right.schema.field("query_id").type), ("doc_id", left.schema.field("ids").type.value_type), ("bm25", pa.float64())]))
        return pa.table({"query_id": queries.take(pa.array(np.concatenate(found_q))), "doc_id": ids.take(pa.array(np.concatenate(found_d))), "bm25": np.concatenate(found_s)})

    return rows.groupBy("block", "part").cogroup(pairs.groupBy("block", "part")).applyInArrow(run, schema)


def _pairs(weights: DataFrame, index: WordIndex, k1: float, b: float) -> DataFrame:
    """(block, query_id, terms, bound): the blocks that hold a term of a query, with the highest score a document there may have."""
    most = _impact(F.col("most").cast("double"), F.col("least"), index.stats["avgdl"], k1, b)
    met = index.terms.select("block", "term", most.alias("impact")).join(weights, "term")
    return met.groupBy("block", "query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"), F.sum(F.col("idf") * F.col("impact")).alias("bound"))


def scores(queries: DataFrame, index: WordIndex, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, bm25) of all documents that share a term with a query."""
    pairs = _pairs(_weights(wanted(queries), index), index, k1, b)
    return _scored(pairs, index, k1, b, max(-(-queries.count() // BLOCK_QUERIES), 1))


def _best_of_groups(asked: DataFrame, used: DataFrame, index: WordIndex, groups: range, of: int, k: int, k1: float, b: float, parts: int, tie: float) -> DataFrame:
    """(query, doc_id, bm25) of asked (query long, terms, idfs, floor): of each of these groups of blocks the k best documents of
    each query, those less than tie below the k-th too, if they reach the floor. used: the queries' terms.

    A group's documents are scored in one array for a query after the other; queries meet it in parts.
    """
    avgdl = index.stats["avgdl"]
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", index.rows.schema["ids"].dataType.elementType), T.StructField("bm25", T.DoubleType())])
    group = F.pmod(F.xxhash64("block"), F.lit(of)).cast("int")
    own, held = [x.withColumn("group", group).filter(F.col("group").between(groups.start, groups.stop - 1)) for x in (index.blocks, index.terms.drop("most", "least"))]
    rows = own.unionByName(held.join(used, "term", "left_semi"), allowMissingColumns=True)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(groups.start), F.lit(groups.stop - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([], pa.schema([("query", pa.int64()), ("doc_id", left.schema.field("ids").type.value_type), ("bm25", pa.float64())]))
        held, own = left.filter(pc.is_valid(left["term"])), left.filter(pc.is_valid(left["ids"]))
        if not held.num_rows or not right.num_rows:
            return empty
        # The documents of the blocks, one after the other, and where each block begins.
        blocks, ids = own["block"].to_numpy(), own["ids"].combine_chunks().flatten()
        lengths = own["lengths"].combine_chunks().flatten().to_numpy()
        begins = np.concatenate(([0], np.cumsum(pc.list_value_length(own["ids"]).to_numpy())[:-1]))
        by_block = np.argsort(blocks)
        # The entries of a term stand together, over all blocks.
        coded = held["term"].combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        held = held.select(["block", "places", "tfs"]).take(pa.array(order))
        sizes = pc.list_value_length(held["places"]).to_numpy()
        base = begins[by_block[np.searchsorted(blocks, held["block"].to_numpy(), sorter=by_block)]]
        places = held["places"].combine_chunks().flatten().to_numpy() + np.repeat(base, sizes)
        impacts = held["tfs"].combine_chunks().flatten().to_numpy().astype(float)
        norm = k1 * (1 - b + b * lengths / avgdl)
        impacts *= (k1 + 1) / (impacts + norm[places])
        ends = np.cumsum(np.bincount(codes[order], weights=sizes).astype(np.int64))
        starts = np.concatenate(([0], ends[:-1]))
        # The terms of the queries, as places in the two arrays; a query's bound is the sum of its terms' largest impacts.
        asked_terms = right["terms"].combine_chunks()
        of_query = np.repeat(np.arange(right.num_rows), pc.list_value_length(asked_terms).to_numpy())
        term = pc.fill_null(pc.index_in(asked_terms.flatten(), value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
        idfs = right["idfs"].combine_chunks().flatten().to_numpy()
        of_query, term, idfs = of_query[term >= 0], term[term >= 0], idfs[term >= 0]
        bounds = np.bincount(of_query, weights=idfs * np.maximum.reduceat(impacts, starts)[term], minlength=right.num_rows)
        floors = pc.fill_null(right["floor"], 0.0).to_numpy()
        cuts = np.searchsorted(of_query, np.arange(right.num_rows + 1))
        scores = np.zeros(len(ids))
        found_q, found_d, found_s = [], [], []
        first, last, weight = starts[term].tolist(), ends[term].tolist(), idfs.tolist()
        for i in np.flatnonzero((bounds > 0) & (bounds >= floors - SLACK)).tolist():
            for j in range(cuts[i], cuts[i + 1]):
                scores[places[first[j] : last[j]]] += weight[j] * impacts[first[j] : last[j]]
            at = np.flatnonzero(scores >= floors[i]) if floors[i] > 0 else np.flatnonzero(scores)
            some = scores[at]
            if len(at) > k:
                reach = some >= np.partition(some, -k)[-k] - SLACK - tie
                at, some = at[reach], some[reach]
            if len(at):
                found_q.append(np.full(len(at), i))
                found_d.append(at)
                found_s.append(some)
            scores.fill(0.0)
        if not found_q:
            return empty
        return pa.table({"query": right["query"].combine_chunks().take(pa.array(np.concatenate(found_q))), "doc_id": ids.take(pa.array(np.concatenate(found_d))), "bm25": np.concatenate(found_s)})

    return rows.groupBy("group", "part").cogroup(asked.groupBy("group", "part")).applyInArrow(run, schema)


def best(queries: DataFrame, index: WordIndex, k: int, places: int = 6, fill: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, bm25, rank): the k best documents of each query; scores equal in so many decimals are ordered by doc_id.

    fill: lists of fewer than k matches go on with the first ids that did not match, at score 0.
    """
    queries = written(queries.select("query_id", "tokens"), "queries")
    held = _weights(wanted(queries), index).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("held"))
    # Queries of the same terms are one.
    sets = held.groupBy("held").agg(F.collect_list("query_id").alias("ids")).withColumn("query", F.monotonically_increasing_id())
    sets = written(sets.select("query", F.col("held.term").alias("terms"), F.col("held.idf").alias("idfs"), "ids"), "sets")
    size = sets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).head()
    parts = max(-(-size["n"] // GROUP_QUERIES), -(-size["terms"] // GROUP_TERMS), 1)
    n, tie = index.stats["n"], 10.0**-places
    groups = max(-(-n // GROUP_DOCS), math.ceil(n * (index.stats["avgdl"] or 0) / GROUP_TOKENS), 1)
    firsts = range(math.isqrt(groups)) if groups > 2 else range(groups)
    used = written(sets.select(F.explode("terms").alias("term")).distinct(), "used")
    asked = sets.select("query", "terms", "idfs", F.lit(None).cast("double").alias("floor"))
    every = _best_of_groups(asked, used, index, firsts, groups, k, k1, b, parts, tie)
    if len(firsts) < groups:
        every = early = written(every, "early")
        lists = early.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bm25"))))
        floors = lists.filter(F.col("n") == k).select("query", (F.col("bm25") - SLACK - tie).alias("floor"))
        asked = asked.drop("floor").join(floors, "query", "left")
        every = early.unionByName(_best_of_groups(asked, used, index, range(len(firsts), groups), groups, k, k1, b, parts, tie))
    found = ranked(every.withColumnRenamed("query", "query_id"), places, k).withColumnRenamed("query_id", "query")
    found = found.join(sets.select("query", F.explode("ids").alias("query_id")), "query").select("query_id", "doc_id", "bm25", "rank")
    if not fill:
        return found
    found = written(found, "found")
    firsts = index.blocks.select(F.explode("ids").alias("doc_id")).orderBy("doc_id").limit(k)  # k ids
    short = queries.select("query_id").distinct().join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").fillna(0, ["n"]).filter(F.col("n") < k)
    rest = short.join(F.broadcast(firsts)).join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("bm25"))
    return ranked(found.drop("rank").unionByName(rest), places, k)


def ranked(scored: DataFrame, places: int, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", places)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
