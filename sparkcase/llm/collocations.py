"""Phrase collocations: counted n-grams from FM-indexes of shards, scored by their weakest cut.

Each task cuts its documents into shards of about SHARD_WORDS words, numbered by a
dictionary of the shard. Words that are rare over the whole corpus become breaks,
as no candidate holds them. Of each shard then only its FM-index remains: the
Burrows-Wheeler transform of its word ids, sorted to the depth that candidates
need, which gives every count by interval extension. Going from phrases of k words
to k + 1, each live interval is extended to the left by the words that stand before
it in the transform, and is kept only where it is also a right extension, that is,
lies in the live interval of its own first k words. A level's counts are summed
across shards, phrases below the least count die, and each shard gets back its own
live ones; so what is shuffled at a level are pairs of live phrases, packed by shard
and bucket of phrases, and no list of words or phrases is broadcast or goes through
the driver.

A phrase is named by the ids of its first and of its last k - 1 words, so the
counts of all its cuts come by joining a level with the one below, and its best
left and right extension by grouping the level above.

Nulls: a null text is an empty one; a null language is "und" (UNKNOWN). Copies and
repeated rows count as often as they occur. A very long text makes its shard longer
by itself, no other way. Empty tables give no rows. Only text and language are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, fresh_path, halved, table

LEAST = 30
LONGEST = 4
TOP = 2000
#: A candidate goes if a longer one that holds it has this percentage of its count.
ABSORBED = 80
SCALE = 2_000_000
UNKNOWN = "und"
SHARD_WORDS = 5_000_000
#: Phrases of all shards that are summed in one task, about.
BUCKET_PHRASES = 1_000_000
#: Salts over which each language's first rows are found before they meet.
SALTS = 64
#: A phrase's id is made of bits for the task, the shard in it, and the place in the shard.
SHARD_BITS, PLACE_BITS = 13, 28
_BREAK = b"\xff"  # no byte of UTF-8
#: Lower-cases A-Z, turns marks and line ends into breaks and tabs into blanks.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)
)


class _Ids(dict):
    """word -> id, given out in order of first sight; languages of a shard share the numbers. The break is 0."""

    def __init__(self, given: list[int]):
        super().__init__({_BREAK: 0})
        self.given = given

    def __missing__(self, word: bytes) -> int:
        self.given[0] += 1
        self[word] = self.given[0]
        return self.given[0]


def word_tokens(text: str) -> list[bytes]:
    """The words of a text, with a break wherever a piece ends."""
    return text.encode().translate(_BYTES).replace(_BREAK, b" \xff ").split()


def packed(*columns: np.ndarray, width: int = 8) -> bytes:
    """Columns of whole numbers of so many bytes, byte by byte of all numbers, compressed."""
    planes = np.stack(columns).astype(f"<u{width}")[..., None].view(np.uint8)
    return pa.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, columns: int = 1, width: int = 8) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=columns * n * width, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, width, n).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view(f"<u{width}")[..., 0]


def shards(df: DataFrame, lang_col: str, text_col: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Of each shard: a row a word (place is its id in the shard, n its count) and one row with all ids (payload, n of them)."""
    names = ["shard", "place", "lang", "word", "n", "payload"]

    def rows(shard: int, words: dict[str, _Ids], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(parts)
        if len(ids) >= 1 << PLACE_BITS:
            raise ValueError(f"one text makes a shard of {len(ids)} words; ids hold {1 << PLACE_BITS}")
        counts = np.bincount(ids)
        for lang, found in words.items():
            every = [(w, i) for w, i in found.items() if i]
            for at in range(0, len(every), 50_000):
                some = every[at : at + 50_000]
                places = np.array([i for _, i in some], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), shard)), pa.array(places, pa.int32()), pa.array([lang] * len(some)),
                    pa.array([w.decode() for w, _ in some], pa.string()), pa.array(counts[places]), pa.nulls(len(some), pa.binary()),
                ], names=names)
        yield pa.RecordBatch.from_arrays([
            pa.array([shard]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([len(ids)]), pa.array([packed(ids, width=4)], pa.binary()),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << SHARD_BITS
        last = shard + (1 << SHARD_BITS) - 1
        given, words, parts, size = [0], {}, [], 0
        for batch in batches:
            for part in halved(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not text or not (tokens := word_tokens(text)):
                        continue
                    if lang not in words:
                        words[lang] = _Ids(given)
                    tokens.append(_BREAK)
                    parts.append(np.fromiter(map(words[lang].__getitem__, tokens), np.uint32, len(tokens)))
                    size += len(tokens)
                    if size >= shard_words and shard < last:
                        yield from rows(shard, words, parts)
                        shard, given, words, parts, size = shard + 1, [0], {}, [], 0
        if parts:
            yield from rows(shard, words, parts)

    source = df.select(F.coalesce(lang_col, F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "shard long, place int, lang string, word string, n long, payload binary")


def transform(ids: np.ndarray, kept: np.ndarray, depth: int = LONGEST) -> np.ndarray:
    """The Burrows-Wheeler transform of ids, where kept[i] renames the i-th id and 0 is a break, of rows sorted by their first depth words."""
    text = np.concatenate((kept[ids], [0]))
    text = text[np.concatenate(([True], (text[1:] > 0) | (text[:-1] > 0)))]
    text = text.astype(np.uint16 if len(text) and text.max() < 1 << 16 else np.uint32)
    ahead = np.concatenate((text, np.zeros(depth, text.dtype)))
    order = np.arange(len(text))
    for k in range(depth - 1, -1, -1):
        order = order[np.argsort(ahead[order + k].astype(np.uint16), kind="stable")]
        if ahead.dtype == np.uint32:
            order = order[np.argsort((ahead[order + k] >> 16).astype(np.uint16), kind="stable")]
    return text[order - 1]


class Index:
    """An FM-index: the transform, where each word's rows begin, and the row to which each row's word before leads."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        order = np.argsort(bwt, kind="stable")
        self.first = bwt[order]  # the first word of each row
        self.back = np.empty(len(bwt), np.int64)
        self.back[order] = np.arange(len(bwt))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all words: where they begin and how long they are."""
        counts = np.bincount(self.bwt)
        return (np.cumsum(counts) - counts)[1:], counts[1:]

    def extended(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of phrases one word longer of which both the first and the last words are among the given intervals.

        Gives where each begins, its length, and the numbers of the intervals of its first and of its last words.
        """
        inside = np.full(len(self.bwt), -1, np.int64)
        total = int(size.sum())
        inside[np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)] = np.repeat(np.arange(len(low)), size)
        rows = np.flatnonzero((inside >= 0) & (self.bwt > 0))
        last = np.full(len(self.bwt), -1, np.int64)
        last[self.back[rows]] = inside[rows]
        at = np.flatnonzero((last >= 0) & (inside >= 0))
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(last[at]) != 0) | (self.first[at[1:]] != self.first[at[:-1]])))
        begins = np.flatnonzero(new)
        lows = at[begins]
        return lows, np.diff(np.concatenate((begins, [len(at)]))), inside[lows], last[lows]


def _global(place: str) -> Column:
    """An id for a place of a shard; the least of all places of a phrase names it."""
    return F.col("shard") * F.lit(1 << PLACE_BITS) + F.col(place)


class _Steps:
    """Tables written on the way, each of which goes when no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """df, written; what it has shuffled goes at once."""
        name, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", self.spark.conf
        before, path = conf.get(name, "false"), fresh_path(self.spark, label)
        conf.set(name, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(name, before)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def gone(self, *labels: str) -> None:
        for label in labels:
            delete(self.spark, self.paths.pop(label))


def _words(counted: DataFrame, least: int) -> DataFrame:
    """The rows of words that count least or more over all shards, with that count f and one id for each word."""
    same = Window.partitionBy("lang", "word")
    summed = counted.select("*", F.sum("n").over(same).alias("f"), F.min(_global("place")).over(same).alias("id")).filter(F.col("f") >= least)
    named = F.col("id") == _global("place")
    return summed.select("shard", "place", "id", "f", *[F.when(named, F.col(c)).alias(c) for c in ("lang", "word")])


def _indexes(tokens: DataFrame, live: DataFrame, depth: int) -> DataFrame:
    """A row a shard: n rows of its transform, how many words it has, and both packed: the transform and the words' ids."""

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["shard", "n", "words", "bwt", "ids"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())], names=names)
        ids = unpacked(left["payload"][0].as_py(), left["n"][0].as_py(), width=4)[0]
        places, global_ids = right["place"].to_numpy(), right["id"].to_numpy()
        by = np.argsort(places)
        kept = np.zeros(int(max(ids.max(), places.max())) + 1, np.uint32)
        kept[places[by]] = np.arange(1, len(places) + 1)
        bwt = transform(ids, kept, depth)
        return pa.table([
            left["shard"].slice(0, 1).combine_chunks(), pa.array([len(bwt)], pa.int64()), pa.array([len(places)], pa.int64()),
            pa.array([packed(bwt, width=4)], pa.binary()), pa.array([packed(global_ids[by])], pa.binary()),
        ], names=names)

    return tokens.groupBy("shard").cogroup(live.groupBy("shard")).applyInArrow(build, "shard long, n long, words long, bwt binary, ids binary")


_BUNDLES = "bucket long, shard long, n long, payload binary"


def _bundles(shard: int, index: Index, low: np.ndarray, size: np.ndarray, ids: np.ndarray, buckets: int) -> pa.Table:
    """The phrases of a shard one word longer than the given ones, a row a bucket: (place, count, left, right) packed.

    The bucket follows from left and right alone, so all shards' counts of a phrase meet in it.
    """
    lows, sizes, first, last = index.extended(low, size)
    left, right = ids[first].astype(np.uint64), ids[last].astype(np.uint64)
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F))
    bucket = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(order) else order
    rows = [(int(bucket[part[0]]), shard, len(part), packed(lows[part], sizes[part], left[part], right[part])) for part in np.split(order, starts[1:]) if len(part)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows) if rows else ((),) * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["bucket", "shard", "n", "payload"])


def _index_of(row_n: int, bwt: bytes) -> Index:
    return Index(unpacked(bwt, row_n, width=4)[0])


def _pairs(indexes: DataFrame, buckets: int) -> DataFrame:
    """The phrases of two words of each shard, in buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, n, words, bwt, ids = (c[i].as_py() for c in batch.columns)
                index = _index_of(n, bwt)
                yield from _bundles(shard, index, *index.words(), unpacked(ids, words)[0], buckets).to_batches()

    return indexes.mapInArrow(run, _BUNDLES)


def _longer(indexes: DataFrame, live: DataFrame, buckets: int) -> DataFrame:
    """The phrases of each shard one word longer than the live ones, in buckets."""

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=["bucket", "shard", "n", "payload"])
        found = np.concatenate([unpacked(p, n, 3) for p, n in zip(right["payload"].to_pylist(), right["n"].to_pylist())], axis=1).astype(np.int64)
        low, size, ids = found[:, np.argsort(found[0])]
        return _bundles(left["shard"][0].as_py(), _index_of(left["n"][0].as_py(), left["bwt"][0].as_py()), low, size, ids, buckets)

    mine = indexes.select("shard", "n", "bwt").groupBy("shard")
    return mine.cogroup(live.select("shard", "n", "payload").groupBy("shard")).applyInArrow(extend, _BUNDLES)


def _summed(bundles: DataFrame, least: int) -> DataFrame:
    """Of each bucket: a row a phrase that counts least or more (id, left, right, f), and a row a shard with its places of these, packed (place, count, id)."""

    def run(table: pa.Table) -> pa.Table:
        shards_, sizes = table["shard"].to_numpy(), table["n"].to_numpy()
        low, n, left, right = np.concatenate([unpacked(p, k, 4) for p, k in zip(table["payload"].to_pylist(), sizes.tolist())], axis=1).astype(np.int64)
        shard = np.repeat(shards_, sizes)
        place = (shard << PLACE_BITS) + low
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(left) != 0) | (np.diff(right) != 0))))
        f, names = np.add.reduceat(n[order], starts), np.minimum.reduceat(place[order], starts)
        good = f >= least
        each = np.repeat(np.where(good, names, -1), np.diff(np.concatenate((starts, [len(order)]))))
        ids = np.empty(len(order), np.int64)
        ids[order] = each
        rows = []
        for a, b in zip((np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist()):
            held = a + np.flatnonzero(ids[a:b] >= 0)
            if len(held):
                rows.append((int(shard[a]), len(held), packed(low[held], n[held], ids[held])))
        m, k = len(rows), int(good.sum())
        own, counts, payloads = zip(*rows) if rows else ((), (), ())
        none = lambda count, kind: pa.nulls(count, kind)
        first = starts[good]
        return pa.table([
            pa.concat_arrays([pa.array(own, pa.int64()), none(k, pa.int64())]), pa.concat_arrays([pa.array(counts, pa.int64()), none(k, pa.int64())]),
            pa.concat_arrays([pa.array(payloads, pa.binary()), none(k, pa.binary())]),
            *[pa.concat_arrays([none(m, pa.int64()), pa.array(x)]) for x in (names[good], left[first], right[first], f[good])],
        ], names=["shard", "n", "payload", "id", "left", "right", "f"])

    return bundles.groupBy("bucket").applyInArrow(run, "shard long, n long, payload binary, id long, left long, right long, f long")


def phrases(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, shard_words: int = SHARD_WORDS
) -> tuple[list[DataFrame], DataFrame]:
    """A table for each length from 2: id, left and right (ids one word shorter), lang, phrase, last word, f, heads and tails; and n by lang.

    heads and tails hold the counts of the phrase's first and last 1, 2, ... words.
    """
    steps = _Steps(df.sparkSession)
    local = steps.write(shards(df, lang_col, text_col, shard_words), "shards")
    counted = local.filter("payload IS NULL").select("shard", "place", "lang", "word", "n")
    totals = steps.write(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = max(-(-(totals.agg(F.sum("n")).head()[0] or 0) // BUCKET_PHRASES), 1)
    words = steps.write(_words(counted, least), "words")
    tokens = local.filter("payload IS NOT NULL").select("shard", "n", "payload")
    indexes = steps.write(_indexes(tokens, words.select("shard", "place", "id"), longest), "indexes")
    steps.gone("shards")
    levels = [words.filter("word IS NOT NULL").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))]
    live = steps.write(_summed(_pairs(indexes, buckets), least), "live2")
    for k in range(2, longest + 1):
        own, parts = live.filter("id IS NOT NULL").alias("o"), [levels[-1].alias(x) for x in "ab"]
        level = own.join(parts[0], F.col("o.left") == F.col("a.id")).join(parts[1], F.col("o.right") == F.col("b.id"))
        levels.append(steps.write(level.select(
            "o.id", "o.left", "o.right", "a.lang", F.concat("a.phrase", F.lit(" "), "b.last").alias("phrase"), "b.last", "o.f",
            F.concat("a.heads", F.array("o.f")).alias("heads"), F.concat("b.tails", F.array("o.f")).alias("tails"),
        ), f"level{k}"))
        if k < longest:
            live = steps.write(_summed(_longer(indexes, live.filter("payload IS NOT NULL"), buckets), least), f"live{k + 1}")
        steps.gone(f"live{k}")
    steps.gone("words", "indexes")
    return levels[1:], totals


def _big(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def scored(levels: list[DataFrame], absorbed: int = ABSORBED, scale: int = SCALE) -> DataFrame:
    """All candidates that no longer one absorbs: lang, phrase, a, l, r and score by the lowest-scoring cut."""
    found = None
    for k, level in enumerate(levels, 2):
        if k <= len(levels):
            above = levels[k - 1]
            best = above.select(F.col("left").alias("id"), "f").unionAll(above.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer"))
            level = level.join(best, "id", "left").filter(F.coalesce(_big("longer") * 100 < _big("f") * absorbed, F.lit(True)))
        cuts = F.array(*[
            F.struct(
                F.expr(f"cast({scale} as decimal(10,0)) * cast(f as decimal(19,0)) div (cast(heads[{j - 1}] as decimal(19,0)) + cast(tails[{k - j - 1}] as decimal(19,0)))").alias("score"),
                F.lit(j).alias("cut"), F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r"),
            )
            for j in range(1, k)
        ])
        rows = level.select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
        found = rows if found is None else found.unionAll(rows)
    return found


def ranked(candidates: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each language, with its n: by salts first, so that a language with most rows is no single task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("at") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    first = some.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    levels, totals = phrases(table(spark, sf_dir, "documents"))
    return ranked(scored(levels), totals)
