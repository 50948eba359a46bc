"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words, as numbers, go into suffix automata of bounded size, built in
tasks from one chunk of items each and written as a table (an item longer than a
chunk goes in overlapping parts, which have the same windows). Each task streams
its documents' words through an automaton: it gives the longest match that ends
at each word, so every occurrence of a window of WINDOW item words (or of a whole
shorter item) is found without hashing windows. One chunk is broadcast at a time
(its size is bounded by CHUNK_WORDS). With a single chunk documents are not
shuffled. With several, each makes a pass over the texts that writes the hits of
each hit text; they are united per word and joined to the documents by the
text's digest, so the result does not depend on the chunking.

Nulls: a null text has no words. Items with a null id or without words are
left out. An item id that several rows have counts once. Extra columns of the
documents are kept; columns with the outputs' names are replaced. Empty tables
work: without items nothing is hit, without documents there are no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import SuffixAutomaton
from .common import append_columns, halved, table, utf8, without, word_list, written

WINDOW = 13
#: A broadcast automaton holds about so many words.
CHUNK_WORDS = 200_000
#: A document is contaminated from one hit word in so many.
COVERAGE = 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_spans", SPANS),
]
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


class ItemMatcher:
    """Finds the windows of some items in lists of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        symbols: list[int] = []
        ends = []
        for item, words in items:
            for w in words:
                symbols.append(self.vocabulary.setdefault(w, len(self.vocabulary)))
            ends.append((item, len(words), len(symbols)))
            symbols.append(-1)
        sam = SuffixAutomaton(symbols)
        self.next, self.link, self.length = sam.next, sam.link, sam.length
        self.items: dict[int, set[str]] = {}  # of the states of whole windows
        short: dict[int, list[tuple[int, str]]] = {}
        for item, n, end in ends:
            if n < window:
                short.setdefault(sam.ancestor(sam.prefix_state[end - 1], n), []).append((n, item))
            for i in range(end - n + window - 1, end):
                self.items.setdefault(sam.ancestor(sam.prefix_state[i], window), set()).add(item)
        self.shortest = min([window, *(n for _, n, _ in ends)])
        # For each state, the short items that end there, by its suffix links.
        self.short: dict[int, list[tuple[int, str]]] = {}
        if short:
            for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                if found := short.get(state, []) + self.short.get(self.link[state], []):
                    self.short[state] = found
        self.window_state: dict[int, int] = {}

    def _window_state(self, state: int) -> int:
        found = self.window_state.get(state)
        if found is None:
            found = state
            while self.length[self.link[found]] >= self.window:
                found = self.link[found]
            self.window_state[state] = found
        return found

    def mark(self, words: list[bytes], hit: np.ndarray, found: set[str]) -> None:
        """Sets hit where a word lies inside a window's occurrence; adds the items to found."""
        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for begin, end in zip(edges[::2], edges[1::2]):
            if end - begin < self.shortest:
                continue
            state = matched = 0
            for i, symbol in enumerate(ids[begin:end].tolist(), int(begin)):
                while state and symbol not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                state = nxt[state].get(symbol, 0)
                matched = matched + 1 if state else 0
                if matched >= window:
                    hit[i - window + 1 : i + 1] = True
                    found |= self.items[self._window_state(state)]
                for size, item in self.short.get(state, ()):
                    if size <= matched:
                        hit[i - size + 1 : i + 1] = True
                        found.add(item)


def automata(benchmark: DataFrame, item_col: str, text_col: str, window: int, chunk_words: int) -> tuple[DataFrame, int]:
    """The pickled matchers of a benchmark's items, as a table (chunk, matcher), and the number of chunks."""
    longest = max(chunk_words, 2 * window)
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna().distinct()

    def parts(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), utf8(batch.column("text"))):
                words = word_list(text)
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), longest - window + 1):
                    out.append((item, b" ".join(words[at : at + longest]), min(len(words) - at, longest)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())],
                names=["item", "words", "n"],
            )

    items = written(rows.mapInArrow(parts, "item string, words binary, n long"), "items")
    chunks = -(-(items.agg(F.sum("n")).first()[0] or 0) // chunk_words)

    def build(group: pa.Table) -> pa.Table:
        matcher = ItemMatcher([(i, w.split()) for i, w in zip(group["item"].to_pylist(), group["words"].to_pylist())], window)
        return pa.table({"chunk": group["chunk"][:1], "matcher": pa.array([pickle.dumps(matcher)], pa.binary())})

    dealt = items.withColumn("chunk", F.pmod(F.xxhash64("item", "words"), F.lit(max(chunks, 1))).cast("int"))
    return written(dealt.groupBy("chunk").applyInArrow(build, "chunk int, matcher binary"), "automata"), chunks


def marked(matcher: ItemMatcher, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """Which words lie inside a window's occurrence, and the items found."""
    hit, found = np.zeros(len(words), bool), set()
    if words:
        matcher.mark(words, hit, found)
    return hit, found


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def _fields(texts: list[bytes | None], hits: list[np.ndarray], found: list[set[str]]) -> list[pa.Array]:
    return [
        pa.array([len(h) for h in hits], pa.int64()),
        pa.array([int(h.sum()) for h in hits], pa.int64()),
        pa.array([sorted(f) for f in found], pa.list_(pa.string())),
        pa.array([spans(t, h) for t, h in zip(texts, hits)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]


def scan(
    documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """documents with n_words, n_hit, item_ids (sorted) and hit_spans.

    hit_spans holds the code points (end exclusive) of the runs of hit words.
    """
    context = documents.sparkSession.sparkContext
    built, chunks = automata(benchmark, item_col, item_text_col, window, chunk_words)
    if chunks > 1:
        return _scan_in_passes(documents, built, chunks, text_col)
    blob = context.broadcast(built.first()["matcher"]) if chunks else None

    def make():
        matcher = pickle.loads(blob.value) if blob else None

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = utf8(batch.column(text_col))
            words = [word_list(t or b"") for t in texts]
            both = [marked(matcher, w) if matcher else (np.zeros(len(w), bool), set()) for w in words]
            return _fields(texts, [h for h, _ in both], [f for _, f in both])

        return compute

    return append_columns(documents, FIELDS, make)


def _scan_in_passes(documents: DataFrame, built: DataFrame, chunks: int, text_col: str) -> DataFrame:
    """As scan, one pass over the texts a chunk: only the hits of texts that have any are kept between passes."""
    context, passes = documents.sparkSession.sparkContext, []
    schema = "__digest string, __runs array<struct<a:int,b:int>>, __items array<string>"
    for chunk in range(chunks):
        row = built.filter(F.col("chunk") == chunk).first()
        if row is None:  # no item was dealt to it
            continue
        blob = context.broadcast(row["matcher"])

        def run(batches, blob=blob):
            matcher = pickle.loads(blob.value)
            for batch in batches:
                for part in halved(batch):
                    out = []
                    for text in utf8(part.column(0)):
                        hit, found = marked(matcher, word_list(text or b""))
                        if found:
                            out.append((hashlib.sha256(text).hexdigest(), [{"a": a, "b": b} for a, b in runs(hit)], sorted(found)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x[0] for x in out], pa.string()),
                        pa.array([x[1] for x in out], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                        pa.array([x[2] for x in out], pa.list_(pa.string())),
                    ], names=["__digest", "__runs", "__items"])

        # Equal texts have equal hits: one row a text and pass.
        passes.append(written(documents.select(text_col).mapInArrow(run, schema).dropDuplicates(["__digest"]), "hits"))
        blob.unpersist()
    every = reduce(DataFrame.unionByName, passes).groupBy("__digest").agg(
        F.flatten(F.collect_list("__runs")).alias("__runs"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"))
    joined = without(documents, ["__digest", "__runs", "__items"]).withColumn("__digest", F.sha2(text_col, 256)).join(written(every, "hits"), "__digest", "left")

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = utf8(batch.column(text_col))
            hits = [np.zeros(len(word_list(t or b"")), bool) for t in texts]
            for hit, some in zip(hits, batch.column("__runs").to_pylist()):
                for r in some or ():
                    hit[r["a"] : r["b"]] = True
            return _fields(texts, hits, [set(x or ()) for x in batch.column("__items").to_pylist()])

        return compute

    return append_columns(joined, FIELDS, make).drop("__digest", "__runs", "__items")


def spans(text: bytes | None, hit: np.ndarray) -> list[dict[str, int]]:
    """Code points of the runs of hit words of a text."""
    if not hit.any():
        return []
    # ASCII letters keep their places when lower-cased; other letters are words either way.
    at = [m.span() for m in _WORD.finditer(text.decode().translate(_LOWER))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs(hit)]


_LOWER = {c: c + 32 for c in range(65, 91)}


def is_contaminated(coverage: int = COVERAGE):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE, longest: int | None = None, text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with their own columns.

    Documents hit over the coverage limit go. If longest is given, the spans of
    more than so many code points are cut from those that stay.
    """
    scanned = scan(documents, benchmark, text_col, **options).filter(~is_contaminated(coverage))
    if longest is not None:
        def cut(texts, spans_):
            pieces, at = [], 0
            for s in spans_:
                if s["end"] - s["start"] > longest:
                    pieces.append(texts[at : s["start"]])
                    at = s["end"]
            return "".join([*pieces, texts[at:]])

        def make():
            return lambda b: [pa.array([t and cut(t, s) for t, s in zip(b.column(text_col).to_pylist(), b.column("hit_spans").to_pylist())], pa.string())]

        scanned = append_columns(scanned, [T.StructField("__cut", T.StringType())], make).withColumn(text_col, F.col("__cut"))
    return scanned.select(*documents.columns)


def op9_decontamination(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(documents, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )
