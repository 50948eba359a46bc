"""A hash-chained, append-only log per case.

Each entry's hash covers its content and the hash before it, so a case's entries
are hashed in their order; cases are independent of each other.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

GENESIS = "0" * 64


def chained(log: DataFrame) -> DataFrame:
    """log (case_id, seq, content) with prev_hash and hash.

    Cases are dealt out and sorted, and each task's entries stream by with the
    last hash alone in memory, so a long log costs its length.
    """
    kinds = {f.name: f.dataType for f in log.schema.fields}
    schema = StructType([StructField(c, kinds[c]) for c in ("case_id", "seq", "content")] + [StructField(c, StringType()) for c in ("prev_hash", "hash")])

    def link(batches):
        case, last = object(), GENESIS
        for batch in batches:
            before, after = [], []
            for c, seq, content in zip(*(batch.column(k).to_pylist() for k in ("case_id", "seq", "content"))):
                if c != case:
                    case, last = c, GENESIS
                before.append(last)
                last = sha256(f"{last}|{seq}|{content}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("case_id", "seq", "content")), pa.array(before, pa.string()), pa.array(after, pa.string())], names=schema.names)

    entries = log.select("case_id", "seq", "content").repartition("case_id").sortWithinPartitions("case_id", "seq", "content")
    return entries.mapInArrow(link, schema)


def broken(chain: DataFrame) -> DataFrame:
    """(case_id, first_bad): the first entry out of sequence, not linked to the one before, or changed; intact cases are absent."""
    order = Window.partitionBy("case_id").orderBy("seq")
    rows = chain.withColumns({"nth": F.row_number().over(order), "before": F.coalesce(F.lag("hash").over(order), F.lit(GENESIS)), "base": F.first("seq").over(order)})
    again = F.sha2(F.concat("prev_hash", F.lit("|"), F.col("seq").cast("string"), F.lit("|"), "content"), 256)
    wrong = (F.col("seq") != F.col("base") + F.col("nth") - 1) | (F.col("prev_hash") != F.col("before")) | (F.col("hash") != again)
    return rows.filter(wrong).groupBy("case_id").agg(F.min("seq").alias("first_bad"))
