"""Token ids as files: documents in ascending id order, Huffman-coded in blocks.

First, every text is encoded where it lies, and the ids are counted over the
whole corpus. Counts give one canonical length-limited Huffman code. Then each
document's ids are coded once, dealt out by ranges of (doc_id, hash of the text)
whose borders come from these two columns, sorted, and written.
The files are Parquet (so any store that Spark reaches will do, and a lost task
is simply run again): one row a document with the ids before it in its part,
its number of ids, its bits, and the bit offset of every block of 256 ids. The
code's lengths are a small table beside it. Reading decodes blocks by a lookup
table, all blocks of a batch together.

Nulls: a null text is an empty one and has only the end id. A null doc_id sorts
first; rows of equal doc_id are ordered by their text's hash, and equal rows stay
next to each other. An empty table gives empty files and no rows. Only the id
and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, delete, fresh_path, halved, table
from .huffman import Codebook, code_lengths
from .pieces import TextEncoder, packed

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Ids that are coded at once, about.
GROUP_IDS = 400_000
#: Pieces that a worker remembers: about 200 MB at most.
MEMO_PIECES = 500_000
FIELDS = [
    T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("blocks", T.ArrayType(T.IntegerType())),
]


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter for each byte (a fixed rule of the format)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


@functools.lru_cache(maxsize=2)
def _encoder(path: str, narrow: bool) -> Callable[[str], bytes]:
    """text -> ids as little-endian integers of 32 bits (narrow: 16), as the tokenizers library gives them.

    A byte-level vocabulary without normalizer or prefix blank is applied by
    the library's model to each distinct piece once. Texts that hold an added
    token, and texts under any other vocabulary, go through the library whole.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    before = spec.get("pre_tokenizer") or {}

    def whole(text: str) -> bytes:
        return packed(tokenizer.encode(text, add_special_tokens=False).ids, narrow)

    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or spec.get("normalizer") or spec["model"]["type"] != "BPE":
        return whole
    letters, tokenize = _byte_letters(), tokenizer.model.tokenize

    def of_piece(piece: str) -> bytes:
        raw = piece if piece.isascii() else piece.encode().decode("latin-1")
        return packed([t.id for t in tokenize(raw.translate(letters))], narrow)

    added, by_pieces = [t["content"] for t in spec.get("added_tokens", ())], TextEncoder(of_piece, MEMO_PIECES)
    return lambda text: whole(text) if any(t in text for t in added) else by_pieces(text)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def encoded(df: DataFrame, path: str, end_id: int, narrow: bool, text_col: str = "text") -> DataFrame:
    """df without its text, with ids: 16-bit where the vocabulary allows (narrow), else 32-bit."""
    kept = df.select(*[c for c in df.columns if c != text_col], F.xxhash64(text_col).alias("text_hash"), text_col)

    def make():
        encode, end = _encoder(path, narrow), packed([end_id], narrow)
        return lambda batch: [pa.array([(encode(t) if t else b"") + end for t in batch.column(text_col).to_pylist()], pa.binary())]

        return compute

    return append_columns(kept, [T.StructField("ids", T.BinaryType())], make).drop(text_col)


def id_counts(ids: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs: one vector of the vocabulary's size a task, summed by id."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in halved(batch):
                total += np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in rows.collect():  # at most one row an id of the vocabulary
        counts[row["id"]] = row["n"]
    return counts


def borders(ids: DataFrame, id_col: str, parts: int) -> list[tuple]:
    """The least (id, text hash) of each part but the first, in order: at most parts rows, from these two columns alone."""
    keys = [F.col(id_col), F.col("text_hash")]
    dealt = ids.select(*keys).repartitionByRange(parts, *keys)
    rows = dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*keys)).alias("least")).collect()
    return sorted((True, r["least"][0], r["least"][1]) if r["least"][0] is not None else (False, r["least"][1]) for r in rows)[1:]


def write_files(df: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes path/documents and path/code for the whole table."""
    spark = df.sparkSession
    size = vocabulary_size(vocabulary)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    held = fresh_path(spark, "ids")
    encoded(df.select(id_col, text_col), vocabulary, end_id, kind == "<u2", text_col).write.option("compression", "zstd").parquet(held)
    ids = spark.read.parquet(held)
    lengths = code_lengths(id_counts(ids, size, kind))
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast(lengths.astype(np.uint8))  # a byte an id of the vocabulary
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = borders(ids, id_col, parts)

    def coder():
        book = Codebook(code.value)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            places = zip(batch.column(id_col).to_pylist(), batch.column("text_hash").to_pylist())
            part = [bisect_right(least, (i is not None, i, h) if i is not None else (False, h)) for i, h in places]
            arrays = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            sizes = np.array([len(a) for a in arrays], np.int64)
            payloads, blocks = [], []
            for group in np.split(np.arange(len(arrays)), np.flatnonzero(np.diff(np.cumsum(sizes) // GROUP_IDS)) + 1):
                found, firsts = book.encode(np.concatenate([arrays[i] for i in group]).astype(np.int64), sizes[group])
                payloads += found
                blocks += [b.tolist() for b in firsts]
            return [pa.array(part, pa.int32()), pa.array(sizes), pa.array(payloads, pa.binary()), pa.array(blocks, pa.list_(pa.int32()))]

        return compute

    # The ids are coded once, on the way to the parts.
    coded = append_columns(ids, [FIELDS[0], *FIELDS[2:]], coder).drop("ids")
    ordered = coded.repartitionById(parts, F.col("part")).sortWithinPartitions(id_col, "text_hash").drop("text_hash")

    def placer():
        before = 0

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            nonlocal before
            n = batch.column("n_tokens").to_numpy()
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            return [pa.array(first.astype(np.int64))]

        return compute

    append_columns(ordered, FIELDS[1:2], placer).write.option("compression", "uncompressed").parquet(f"{path}/documents")
    delete(spark, held)


def read_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents read back: id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    lengths_of = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/code").collect()}  # bounded by the vocabulary
    lengths = np.zeros(max(lengths_of, default=0) + 1, np.uint8)
    for i, bits in lengths_of.items():
        lengths[i] = bits
    code = spark.sparkContext.broadcast(lengths)
    files = spark.read.parquet(f"{path}/documents")
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a part file

    def decoder():
        book = Codebook(code.value)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            sizes = batch.column("n_tokens").to_pylist()
            ids = book.decode(batch.column("payload").to_pylist(), sizes, batch.column("blocks").to_pylist())
            data, at = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(sizes))) * 4
            out = [data[a:b] for a, b in zip(at.astype(int).tolist(), at[1:].astype(int).tolist())]
            return [pa.array(out, pa.binary()), pa.array([zlib.crc32(x) for x in out], pa.int64())]

        return compute

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType())]
    decoded = append_columns(files, fields, decoder)
    return decoded.join(F.broadcast(bases), "part").select(
        id_col, (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids", "ids_crc32"
    )


def op6_token_files(spark, sf_dir):
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return read_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
