"""All pairs of names whose token-sort ratio reaches a threshold.

The ratio of two texts of lengths a and b with longest common subsequence L is
2L / (a + b). Reaching t means L >= ceil(t (a + b) / 2), which leaves so few
insertions and deletions that the texts share c = 3L - a - b - 1 pairs of adjacent
letters or more: each letter that only one side has breaks two of its own side's
pairs and one of the other's. Texts so short that c < 1 differ by a few letters; for
these, what is left after taking away as many letters as may differ is equal on both
sides. Both are proofs: no match is lost.

Pairs of lengths with c < 1 meet by such remainders as keys. Keys carry the entry's
length, so lengths that cannot match never meet. A key with many entries is split by
hash, and its queries meet each part. What shares a key must pass the length of the
common letters, L or more, before the ratio is computed.

All other lengths meet in blocks of bounded size. In texts of some length most letter
pairs are frequent, so keys of single ones would let each two texts meet many times;
here one matrix product gives how many letter pairs each query shares with each entry
of the block, or more, and only where these are c or more the ratio is computed.
Names are compared once, however many rows have them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import WORD, indel, letter_masks, ratio_udf
from ..session import written

#: Below this threshold, letter pairs decide too little.
LEAST_THRESHOLD = 0.75
#: Places of the table in which letter pairs are counted: all that is broadcast.
TABLE = 1 << 15
#: Entries of a key that are joined at once, about.
PART_ROWS = 2_000
#: Entries of a block and queries that meet it at once, about; queries of one matrix product, and pairs of one run over their letters.
BLOCK_ENTRIES, BLOCK_QUERIES, ROWS, RUN = 8_192, 2_048, 256, 100_000
#: Columns of the matrices, those at the end shared by all but the most frequent letter pairs.
COLUMNS, SHARED = 512, 64
_EPS = 1e-9


def ordered(name: Column) -> Column:
    """The words of a name in order, joined by blanks."""
    return F.array_join(F.array_sort(F.filter(F.split(name, r"\s+"), lambda w: w != "")), " ")


def common(a: int, b: int, threshold: float) -> int:
    """The least common subsequence of texts of these lengths that reach the threshold; beyond either length if none can."""
    return math.ceil(threshold * (a + b) / 2 - _EPS)


def shared(a: int, b: int, threshold: float) -> int:
    """How many letter pairs two matching texts of these lengths share at least."""
    return 3 * common(a, b, threshold) - a - b - 1


def partners(a: int, threshold: float) -> range:
    """The lengths that can match this one."""
    low = math.ceil(a * threshold / (2 - threshold) - _EPS)
    return range(low, math.floor(a * (2 - threshold) / threshold + _EPS) + 1)


def letter_pairs(text: str) -> list[str]:
    """Pairs of adjacent letters; a repeated one is told apart by its number."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - 1):
        pair = text[i : i + 2]
        seen[pair] = seen.get(pair, 0) + 1
        out.append(f"{pair}{seen[pair]}")
    return out


def _place(pair: str) -> int:
    value = 0
    for c in pair[:2]:
        value = value * 0x9E3779B1 + ord(c)
    return (value ^ value >> 15) % TABLE


def _remainders(text: str, most: int) -> set[str]:
    """What is left of a text after taking away up to so many letters."""
    out = {text}
    for k in range(1, min(most, len(text)) + 1):
        for gone in combinations(range(len(text)), k):
            skip = set(gone)
            out.add("".join(c for i, c in enumerate(text) if i not in skip))
    return out


def keys_of(text: str, counts: list[int] | None, threshold: float, as_query: bool) -> list[tuple[str, int]]:
    """(key, length of the entry) under which a text is looked up or held; without counts only those for pairs of short lengths."""
    own, pairs, out = len(text), None, set()
    longest: dict[int, int] = {}
    taken = -1
    for other in partners(own, threshold):
        length = other if as_query else own
        if (c := shared(own, other, threshold)) >= 1:
            if counts is None:
                continue
            pairs = pairs or sorted(letter_pairs(text), key=lambda p: (counts[_place(p)], p))
            longest[length] = max(longest.get(length, 0), len(pairs) - c + 1)
        else:
            most = own - common(own, other, threshold)
            if as_query:
                out.update((f"={r}", length) for r in _remainders(text, most))
            else:
                taken = max(taken, most)
    if taken >= 0:
        out.update((f"={r}", own) for r in _remainders(text, taken))
    for length, n in longest.items():
        out.update((f"~{p}", length) for p in pairs[:n])
    return sorted(out)


def _columns(names: DataFrame) -> np.ndarray:
    """The column of each place: the most frequent letter pairs have one of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=TABLE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "n"])

    counts = names.select("places").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    own = [r["place"] for r in counts.orderBy(F.desc("n"), "place").limit(COLUMNS - SHARED).collect()]
    out = (COLUMNS - SHARED + np.arange(TABLE) % SHARED).astype(np.int16)
    out[own] = np.arange(len(own))
    return out


def _placed(names: DataFrame) -> DataFrame:
    """(text, places): the places of each text's letter pairs, told apart by their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [[(_place(p) + 7919 * (int(p[2:]) - 1)) % TABLE for p in letter_pairs(t)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32()))], names=["text", "places"])

    return names.select("text").mapInArrow(run, "text string, places array<int>")


def _matrix(places: pa.ChunkedArray, columns: np.ndarray) -> np.ndarray:
    """How often each text has the letter pairs of each column."""
    lists = places.combine_chunks()
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return np.bincount(of * COLUMNS + columns[lists.flatten().to_numpy()], minlength=len(lists) * COLUMNS).reshape(-1, COLUMNS).astype(np.float32)


class _Entries:
    """The texts of a block, ready to be compared with many queries."""

    def __init__(self, texts: list[str]):
        self.texts, self.lengths = texts, np.array([len(t) for t in texts])
        masks = letter_masks([t if len(t) <= WORD else "" for t in texts])
        self.number = {c: i for i, c in enumerate(masks)}
        self.masks = np.stack([*masks.values(), np.zeros(len(texts), np.uint64)])  # the last is of letters that no entry has

    def ratios(self, asked: list[str], q: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The ratio of each pair of a query and an entry, by number."""
        letters = np.full((max(map(len, asked)), len(asked)), len(self.number))
        for i, text in enumerate(asked):
            letters[: len(text), i] = [self.number.get(c, len(self.number)) for c in text]
        out = np.zeros(len(q))
        own = np.array([len(t) for t in asked])
        for at in range(0, len(q), RUN):
            x, y = q[at : at + RUN], e[at : at + RUN]
            row = np.full(len(x), ~np.uint64(0))
            for line in letters:
                hit = row & self.masks[line[x], y]
                row = (row + hit) | (row - hit)
            n = self.lengths[y]
            kept = np.where(n >= WORD, ~np.uint64(0), (np.uint64(1) << np.minimum(n, WORD - 1).astype(np.uint64)) - np.uint64(1))
            found = 2 * (n - np.bitwise_count(row & kept)) / (own[x] + n)
            for i in np.flatnonzero(n > WORD):
                found[i] = indel(asked[x[i]], self.texts[y[i]])
            out[at : at + RUN] = found
        return out


def _in_blocks(asked: DataFrame, held: DataFrame, threshold: float, block_entries: int, block_queries: int) -> DataFrame:
    """(q, e, score): the matching pairs of texts (text, places) of lengths that make them share letter pairs."""
    spark = held.sparkSession
    blocks, parts = (max(-(-df.count() // size), 1) for df, size in ((held, block_entries), (asked, block_queries)))
    columns = spark.sparkContext.broadcast(_columns(held))
    number = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    e = held.withColumn("block", number(blocks)).withColumn("part", every(parts))
    q = asked.withColumn("part", number(parts)).withColumn("block", every(blocks))
    none = pa.table({"q": pa.array([], pa.string()), "e": pa.array([], pa.string()), "score": pa.array([], pa.float64())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        queries, entries = left["text"].to_pylist(), _Entries(right["text"].to_pylist())
        lengths, which = np.unique(entries.lengths, return_inverse=True)
        has, asks = _matrix(right["places"], columns.value).T, _matrix(left["places"], columns.value)
        needs: dict[int, np.ndarray] = {}
        found_q, found_e, found_s = [], [], []
        for at in range(0, len(queries), ROWS):
            some = queries[at : at + ROWS]
            both = asks[at : at + ROWS] @ has
            for i, text in enumerate(some):
                if (own := len(text)) not in needs:
                    least = np.full(len(lengths), np.inf, np.float32)
                    for k, other in enumerate(lengths.tolist()):
                        if common(own, other, threshold) <= min(own, other) and (c := shared(own, other, threshold)) >= 1:
                            least[k] = c
                    needs[own] = least[which]
                both[i] -= needs[own]
            x, y = np.nonzero(both >= 0)
            if len(x):
                score = entries.ratios(some, x, y)
                good = np.flatnonzero(score >= threshold - _EPS)
                found_q.append(x[good] + at)
                found_e.append(y[good])
                found_s.append(score[good])
        if not found_q:
            return none
        take = lambda t, i: t["text"].combine_chunks().take(pa.array(np.concatenate(i)))
        return pa.table({"q": take(left, found_q), "e": take(right, found_e), "score": np.concatenate(found_s)})

    # So many tasks: what is shuffled is small beside the work on it.
    tasks = max(min(blocks * parts, spark.sparkContext.defaultParallelism), blocks * parts // 4)
    dealt = lambda df: df.repartition(tasks, "block", "part").groupBy("block", "part")
    return dealt(q).cogroup(dealt(e)).applyInArrow(run, "q string, e string, score double")


def _keyed(names: DataFrame, threshold: float, as_query: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, key, length = [], [], []
            for t in batch.column(0).to_pylist():
                found = keys_of(t, None, threshold, as_query)
                text += [t] * len(found)
                key += [k for k, _ in found]
                length += [n for _, n in found]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(key, pa.string()), pa.array(length, pa.int32())], names=["text", "key", "length"])

    return names.select("text").mapInArrow(run, "text string, key string, length int")


def _letters(text: Column) -> Column:
    """The letters of a text; a repeated one is told apart by how many stand before it."""
    each = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.transform(each, lambda c, i: F.concat(c, F.lit("\x00"), (i - F.array_position(each, c)).cast("string")))


def _by_remainders(asked: DataFrame, held: DataFrame, threshold: float, part_rows: int) -> DataFrame:
    """(q, e, score): the matching pairs of texts of lengths that need not share a letter pair."""
    keys = written(_keyed(held, threshold, False), "keys")
    large = keys.groupBy("key", "length").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part_rows).select("key", "length", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    right = keys.join(large, ["key", "length"], "left").select(
        F.col("text").alias("e"), "key", "length", F.coalesce(F.pmod(F.xxhash64("text"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    left = _keyed(asked, threshold, True).join(large, ["key", "length"], "left").select(
        F.col("text").alias("q"), "key", "length", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))).alias("part"))
    met = left.join(right, ["key", "length", "part"]).select("q", "e").distinct()
    least = F.ceil(F.lit(threshold) * (F.length("q") + F.length("e")) / 2 - _EPS)
    near = met.filter(F.size(F.array_intersect(_letters(F.col("q")), _letters(F.col("e")))) >= least)
    return near.withColumn("score", ratio_udf("q", "e")).filter(F.col("score") >= threshold - _EPS)


def matches(
    queries: DataFrame, entries: DataFrame, threshold: float, query_col: str = "name", entry_col: str = "name", part_rows: int = PART_ROWS,
    block_entries: int = BLOCK_ENTRIES, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(q, e, score): all pairs of different ordered names of queries and entries that reach the threshold; null names match nothing."""
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"the threshold must lie between {LEAST_THRESHOLD} and 1")
    asked, held = (
        written(_placed(df.select(ordered(F.col(c)).alias("text")).filter("text IS NOT NULL").distinct()), "names")
        for df, c in ((queries, query_col), (entries, entry_col)))
    return _in_blocks(asked, held, threshold, block_entries, block_queries).unionByName(_by_remainders(asked, held, threshold, part_rows))


def join(queries: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, customer_id, score): the best score of a customer's names for each query (query_id, name), from the threshold on."""
    found = matches(queries, entries, threshold)
    q = queries.select("query_id", ordered(F.col("name")).alias("q"))
    e = entries.select("customer_id", ordered(F.col("name")).alias("e"))
    return found.join(q, "q").join(e, "e").groupBy("query_id", "customer_id").agg(F.max("score").alias("score"))


def best(queries: DataFrame, entries: DataFrame, threshold: float, k: int) -> DataFrame:
    """(query_id, customer_id, score, rank): the k best customers of each query by the best score of their names, ties by customer_id.

    Each name brings only the k first of its customers, so how many rows have a name does not multiply.
    """
    first = lambda df, by, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)
    order = (F.desc("score"), "customer_id")
    e = entries.select("customer_id", ordered(F.col("name")).alias("e")).filter("e IS NOT NULL").distinct()
    heads = first(e, "e", "customer_id").drop("rank")
    near = matches(queries, entries, threshold).join(heads, "e").groupBy("q", "customer_id").agg(F.max("score").alias("score"))
    q = queries.select("query_id", ordered(F.col("name")).alias("q")).distinct()
    return first(first(near, "q", *order).drop("rank").join(q, "q").groupBy("query_id", "customer_id").agg(F.max("score").alias("score")), "query_id", *order)
