"""Near-duplicate classes by BagMinHash over multisets of word shingles.

A document is the multiset of its runs of SHINGLE words (fewer words: one run);
two documents are near-duplicates if their multisets' weighted Jaccard
similarity is SIMILARITY or more; classes are the connected components.

1. BagMinHash. An element of weight w has Poisson processes over the discrete
   weights below w, arranged as a hierarchy of doubling intervals; a point's
   place inside its interval is split off by hash bits, and points at or above
   w do not count. Each point falls into one of the signature's components, and
   a component keeps its earliest point. Points are drawn in order of time and
   only up to the horizon at which all components are filled, so most elements
   cost one draw. Two signatures agree in a component with a probability that
   is exactly the weighted Jaccard similarity.
2. Documents with the same words are one node (their least id).
3. Bands of signature rows give buckets. The nodes of a bucket of up to SMALL
   are compared with each other, those of a larger bucket with a centre, which
   is another node in every CENTRES-th band.
4. Compared pairs are verified by the exact overlap of their multisets (as
   64-bit hashes of the shingles).
5. In a larger bucket that is not one class by then, every node outside the
   bucket's largest class is compared with every node of another class: the
   nodes are dealt into blocks, and two blocks meet in a group of their own. So
   every pair that shares a bucket is compared or in one class, and no bucket is
   the work of one task. Two nodes of the largest class never meet again, so the
   rows sent grow with the square of what lies outside it, in blocks.

A pair at the limit misses all BANDS buckets with probability below 1e-5.

Nulls: a null text is alone in its class; texts without words are alike only if
they are equal. A row of null id is returned with a null class. Rows of one id
are one document. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table, utf8, word_list, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
SMALL = 8
CENTRES = 3
#: Members and shingles of a block of a large bucket, on average.
BLOCK = 512
BLOCK_SHINGLES = 200_000
BATCH_BYTES = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bags(lists: list[list[bytes]], hashes: WordHashes, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of some documents' words: document, 50-bit hash, count; by document, then hash."""
    sizes = np.array([len(w) for w in lists], np.int64)
    n = int(sizes.sum())
    words = np.fromiter(chain.from_iterable(map(hashes.__getitem__, w) for w in lists), np.uint64, n)
    doc = np.repeat(np.arange(len(lists)), sizes)
    # A run of fewer than `shingle` words, at a document's end, counts only if it is the whole document.
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    first = np.arange(n) == np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = words.copy()
    for k in range(1, shingle):
        inside = np.flatnonzero(left > k)
        h[inside] = mix(h[inside] * _GOLD + words[inside + k])
    begins = (left >= shingle) | first
    key = (doc[begins].astype(np.uint64) << np.uint64(50)) | (mix(h[begins]) >> np.uint64(14))
    key.sort()
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> np.uint64(50)).astype(np.int64), key & np.uint64((1 << 50) - 1), np.diff(np.append(at, int(begins.sum())))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """BagMinHash signatures (n_docs x size) of weighted sets; rows of empty sets are 0."""
    total = np.bincount(doc, weight, n_docs)
    times = np.full(n_docs * size, np.inf)
    ids = np.zeros(n_docs * size, np.uint64)
    # Process j > 0 covers the weights from 2^(j-1) up to 2^j; process 0 those below 1.
    parts = [(doc, element, np.ones(len(doc)), weight, 0)]
    top, j = int(weight.max(initial=0)), 1
    while 1 << (j - 1) < top:
        has = np.flatnonzero(weight > 1 << (j - 1))
        parts.append((doc[has], element[has], np.full(len(has), float(1 << (j - 1))), weight[has], j))
        j += 1
    owner = np.concatenate([p[0] for p in parts])
    seed = np.concatenate([mix(p[1] * _GOLD + np.uint64(p[4])) for p in parts])
    rate = np.concatenate([p[2] for p in parts]) * size
    limit = np.concatenate([p[3] for p in parts])
    low = np.concatenate([np.full(len(p[0]), (1 << (p[4] - 1)) if p[4] else 0, np.int64) for p in parts])
    when = np.zeros(len(owner))
    drawn = np.zeros(len(owner), np.uint64)
    horizon = (np.log(size) + 2) / np.maximum(total, 1e-300)

    def draw(which: np.ndarray) -> np.ndarray:
        """The next point of these processes; returns their hashes."""
        drawn[which] += np.uint64(1)
        h = mix(seed[which] + drawn[which] * _GOLD)
        when[which] -= np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[which]
        return h

    point = draw(np.arange(len(owner)))
    pending = np.arange(len(owner))  # processes whose drawn point, point[i], is not used yet
    while True:
        active = pending[when[pending] <= horizon[owner[pending]]]
        while len(active):
            h = point[active]
            inside = low[active] + (mix(h + np.uint64(1)) % np.maximum(low[active], 1).astype(np.uint64)).astype(np.int64) * (low[active] > 0) < limit[active]
            slot = owner[active] * size + (mix(h + np.uint64(2)) % np.uint64(size)).astype(np.int64)
            slot, t, h = slot[inside], when[active][inside], h[inside]
            np.minimum.at(times, slot, t)
            won = times[slot] == t
            ids[slot[won]] = h[won]
            point[active] = draw(active)
            active = active[when[active] <= horizon[owner[active]]]
        lacking = (np.isinf(times).reshape(n_docs, size).any(axis=1)) & (total > 0)
        if not lacking.any():
            return ids.reshape(n_docs, size)
        horizon[lacking] *= 2
        pending = np.flatnonzero(lacking[owner])


def band_keys(ids: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = ids.reshape(len(ids), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), grid.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _GOLD + grid[:, :, r])
    return key.view(np.int64)


def sketched(df: DataFrame, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """df without its text, with digest (of the words), n (shingles) and the bands' keys."""

    def make():
        hashes = WordHashes()

        def some(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, list[list[int]]]:
            words = [word_list(t) for t in texts]
            # The words alone decide; a text without words is its own.
            digests = [xxhash.xxh3_128_digest(b" ".join(w) if w else b"\0" + t) for w, t in zip(words, texts)]
            doc, element, count = bags(words, hashes, shingle)
            n = np.bincount(doc, count, len(texts)).astype(np.int64)
            keys = band_keys(signatures(doc, element, count, len(texts), bands * rows), bands, rows)
            return digests, n, [k.tolist() if m else [] for k, m in zip(keys, n)]

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = utf8(batch.column(text_col))
            digests, sizes, keys = [None] * len(texts), [0] * len(texts), [[]] * len(texts)
            group, held = [], 0
            present = [i for i, t in enumerate(texts) if t is not None]
            for i in [*present, None]:
                if i is not None:
                    group.append(i)
                    held += len(texts[i])
                if group and (i is None or held > BATCH_BYTES or len(group) >= 8192):
                    for j, d, n, k in zip(group, *some([texts[j] for j in group])):
                        digests[j], sizes[j], keys[j] = d, int(n), k
                    group, held = [], 0
            return [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]

        return compute

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return append_columns(df, fields, make).drop(text_col)


def bag(words: list[bytes], hashes: WordHashes, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of one document's words: 64-bit hashes, ascending, and counts."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - shingle + 1, min(len(h), 1))
    out = h[:n].copy()
    for k in range(1, min(shingle, len(h))):
        out = mix(out * _GOLD + h[k : k + n])
    return np.unique(out, return_counts=True)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' multisets overlap enough. texts: (node, text)."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    # Merge joins at every size: what would be broadcast grows with the documents. The text of a, which may have
    # many pairs, comes last and is not shuffled once a pair; a hot a is split by the skew join.
    both = pairs.hint("merge").join(right, "b").hint("merge").join(left, "a").select("a", "b", "text_a", "text_b")

    def make():
        hashes = WordHashes()

        @lru_cache(maxsize=64)
        def bag_of(text: bytes):
            return bag(word_list(text), hashes, shingle)

        def close(a: bytes, b: bytes) -> bool:
            (ea, ca), (eb, cb) = bag_of(a), bag_of(b)
            _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
            shared = int(np.minimum(ca[ia], cb[ib]).sum())
            return shared >= similarity * (int(ca.sum()) + int(cb.sum()) - shared) - 1e-9

        return lambda batch: [pa.array([close(a, b) for a, b in zip(utf8(batch.column("text_a")), utf8(batch.column("text_b")))], pa.bool_())]

    return append_columns(both, [T.StructField("close", T.BooleanType())], make).filter("close").select("a", "b")


def candidates(nodes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b), a < b, of nodes (node, n, keys) to be compared first, and the members of large buckets."""
    members = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    stats = members.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("node", F.col("band") % CENTRES), "node", "n")).alias("centre")
    )
    # Written first: the join of plain tables is a skew join, which splits a large bucket.
    stats = written(stats.filter("size > 1"), "buckets")
    inside = written(members.hint("merge").join(stats, ["band", "key"]), "members")
    small = inside.filter(F.col("size") <= SMALL).select("band", "key", "node", "n")
    other = small.select("band", "key", F.col("node").alias("b"), F.col("n").alias("n_b"))
    large = inside.filter(F.col("size") > SMALL)
    pairs = small.join(other, ["band", "key"]).filter(F.col("node") < F.col("b")).select(F.col("node").alias("a"), "n", "b", "n_b").unionByName(
        large.filter(F.col("node") != F.col("centre.node")).select(
            F.least("centre.node", "node").alias("a"), F.col("centre.n").alias("n"), F.greatest("centre.node", "node").alias("b"), F.col("n").alias("n_b")))
    # No pair of such different sizes can be similar enough.
    pairs = pairs.filter(F.least("n", "n_b") >= similarity * F.greatest("n", "n_b") - 1e-9)
    return pairs.select("a", "b").distinct(), large.select("band", "key", "node", "n")


def mixed(large: DataFrame, label: DataFrame) -> DataFrame:
    """The members of large buckets that are not one class: band, key, node, class, block, and the bucket's numbers of minor and of all blocks.

    Members outside the bucket's largest class lie in the minor blocks, which come first.
    """
    crowd = written(_labelled(large, label, "node").withColumnRenamed("class_node", "class"), "crowd")
    by_class = crowd.groupBy("band", "key", "class").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    most = F.max(F.struct("size", "class", "total"))
    blocks = lambda size, total: F.ceil(F.greatest(size / BLOCK, total / BLOCK_SHINGLES)).cast("int")
    several = by_class.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("classes"), most.alias("most"), F.sum("size").alias("size"), F.sum("total").alias("total")
    ).filter("classes > 1").select(
        "band", "key", F.col("most.class").alias("major"), blocks(F.col("size") - F.col("most.size"), F.col("total") - F.col("most.total")).alias("minors"),
        blocks(F.col("most.size"), F.col("most.total")).alias("majors"),
    )
    rows = crowd.hint("merge").join(written(several, "buckets"), ["band", "key"])
    dealt = F.xxhash64("node", "band")
    block = F.when(F.col("class") == F.col("major"), F.col("minors") + F.pmod(dealt, F.col("majors"))).otherwise(F.pmod(dealt, F.col("minors")))
    return rows.select("band", "key", "node", "class", block.cast("int").alias("mine"), "minors", (F.col("minors") + F.col("majors")).alias("blocks"))


def compared(members: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (u, v) of classes that similar pairs of a bucket's members join. members: as mixed gives them."""
    others = F.when(F.col("mine") < F.col("minors"), F.col("blocks")).otherwise(F.col("minors"))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    met = met.select("node", "class", "band", "key", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    told = nodes.select("node", "keys").hint("merge").join(texts, "node")
    rows = met.hint("merge").join(told, "node")

    def run(group: pa.Table) -> pa.Table:
        u, v = joined(group, shingle, similarity)
        return pa.table({"u": pa.array(u, group["class"].type), "v": pa.array(v, group["class"].type)})

    schema = T.StructType([T.StructField(c, nodes.schema["node"].dataType) for c in ("u", "v")])
    return rows.groupBy("band", "key", "lo", "hi").applyInArrow(run, schema).distinct()


@lru_cache(maxsize=1)
def _hashes() -> WordHashes:
    return WordHashes()


def joined(group: pa.Table, shingle: int, similarity: float) -> tuple[list, list]:
    """Compares the members of two blocks (or one) of a bucket; a pair that meets in an earlier band is left to that."""
    n_docs, band = group.num_rows, group["band"][0].as_py()
    lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
    mine = group["mine"].to_numpy()
    names, label = np.unique(np.array(group["class"].to_pylist()), return_inverse=True)
    if len(names) < 2:
        return [], []
    keys = np.array(group["keys"].to_pylist(), np.int64)[:, :band]
    parts = [bag(word_list(t), _hashes(), shingle) for t in utf8(group["text"])]
    begin = np.cumsum([0, *(len(e) for e, _ in parts)])
    doc = np.repeat(np.arange(n_docs), np.diff(begin))
    element, count = map(np.concatenate, zip(*parts))
    names_of, element = np.unique(element, return_inverse=True)
    size = np.bincount(doc, count, n_docs)
    held = np.zeros(len(names_of), np.int64)
    into = np.arange(len(names))
    for a in np.flatnonzero(mine == lo):
        open_ = (label != label[a]) & (np.minimum(size, size[a]) >= similarity * np.maximum(size, size[a]) - 1e-9)
        open_ &= (np.arange(n_docs) > a) if lo == hi else (mine == hi)
        open_ &= ~(keys == keys[a]).any(axis=1)
        if not open_.any():
            continue
        own = slice(begin[a], begin[a + 1])
        held[element[own]] = count[own]
        which = open_[doc]
        shared = np.bincount(doc[which], np.minimum(count[which], held[element[which]]), n_docs)
        held[element[own]] = 0
        for b in np.flatnonzero(open_ & (shared >= similarity * (size[a] + size - shared) - 1e-9)):
            x, y = sorted((label[a], label[b]))
            if x != y:
                label[label == y] = x
                into[into == y] = x
    moved = np.flatnonzero(into != np.arange(len(names)))
    return names[moved].tolist(), names[into[moved]].tolist()


def classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row for each row of df: its id and class_id, the least id of its class."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketches = written(sketched(docs, "text", shingle, bands, rows), "sketches")
    nodes = written(
        sketches.filter("digest is not null and id is not null").groupBy("digest")
        .agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes",
    )
    pairs, large = candidates(nodes, similarity)
    pairs = written(pairs, "pairs")

    def texts_of(involved: DataFrame) -> DataFrame:
        rows = docs.withColumnsRenamed({"id": "node"}).join(involved.distinct().hint("merge"), "node", "left_semi")
        return written(rows.groupBy("node").agg(F.min("text").alias("text")), "texts")

    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    edges = verified(pairs, texts, shingle, similarity).select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = components(written(edges, "edges"))
    crowd = written(mixed(large, label), "mixed")
    if not crowd.isEmpty():
        more = compared(crowd, nodes, texts_of(crowd.select("node")), shingle, similarity)
        again = components(written(more, "edges"))
        own = _labelled(_labelled(nodes.select("digest", "node"), label, "node").select("digest", F.col("class_node").alias("of_label")), again, "of_label")
        own = own.select("digest", F.col("class_of_label").alias("class"))
    else:
        own = _labelled(nodes.select("digest", "node"), label, "node").select("digest", F.col("class_node").alias("class"))
    return sketches.select("id", "digest").join(own, "digest", "left").select(
        F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class_id")
    )


def _labelled(df: DataFrame, label: DataFrame, col: str) -> DataFrame:
    """df with class_<col>, the class of the node in col."""
    of = label.select(F.col("u").alias(col), F.col("v").alias("of"))
    return df.join(of, col, "left").withColumn(f"class_{col}", F.coalesce("of", col)).drop("of")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df's rows whose id is the least of its class, or null; equal rows once."""
    kept = classes(df, id_col, text_col, **options).filter(F.col(id_col) == F.col("class_id")).select(id_col).distinct()
    firsts = df.join(kept.hint("merge"), id_col, "left_semi").dropDuplicates([id_col])
    return firsts.unionByName(df.filter(F.col(id_col).isNull()))


def op3_near_dedup(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(documents)
