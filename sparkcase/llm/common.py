"""What the operators share: the shared folder, written tables, Arrow mapping, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Lower-cases A-Z and turns every byte that is no digit, letter or part of a
#: non-ASCII character into a space, so that bytes.split() gives the words
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased UTF-8 text.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def word_list(text: bytes) -> list[bytes]:
    """The lower-cased words of a UTF-8 text."""
    return text.translate(_WORD_BYTES).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir.

    Only where a local session names none (as in tests) is a local one made and
    set; on a cluster a folder of one machine would lose what others write.
    """
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return found
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/sparkcase-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: The paths handed out in this process and not deleted yet.
_made: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table written by this module, through Hadoop's file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _made:
        _made.remove(path)


def made() -> list[str]:
    """The tables written so far; those of a step may be deleted once its own result is written."""
    return list(_made)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns of these names, in any case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in taken])


#: Batches are handed on in parts of about so many bytes (or a single row).
PART_BYTES = 4_000_000


def halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.nbytes <= PART_BYTES or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from halved(batch.slice(0, half))
    yield from halved(batch.slice(half))


def append_columns(
    df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]
) -> DataFrame:
    """df with the fields that make()(batch) computes for each part of an Arrow batch.

    make runs once in each Python worker task. Columns of df that have a new
    field's name are replaced.
    """
    kept = without(df, [f.name for f in fields])
    schema = T.StructType([*kept.schema.fields, *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            compute = compute or make()
            for part in halved(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(part)], names=names)
        # The worker lives on: what this task held goes back.
        compute = None
        pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()
