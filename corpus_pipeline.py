"""A training-data pipeline over documents; each stage is written as Parquet and reread.

All stages but the last return the columns of documents, whatever their names.
Nulls: a null text goes with the first stage (no language); the stages alone keep
it and take it for an empty one (near-duplicates: for a class of its own). Rows of
null doc_id stay where the operator keeps them. Equal rows of one doc_id are one
document for near-duplicates. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcase.llm import bpe, common, decontaminate, language, near_dup, pii


def _renamed(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator(docs) with all columns but the text under other names meanwhile, so that no output replaces one."""
    names = {c: c if c == "text" else f"__kept{i}" for i, c in enumerate(docs.columns)}
    found = operator(docs.select(*[F.col(c).alias(n) for c, n in names.items()]))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language is found (no text, no letter) go."""
    model = language.fit(docs.filter(~language.held_out()))
    return _renamed(docs, lambda d: language.predict(d, model).filter(F.col("lang_pred") != language.UNKNOWN))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, stays of each class of near-duplicates."""
    return near_dup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark passages go."""
    benchmark = common.table(spark, sf_dir, "benchmark")
    return _renamed(docs, lambda d: decontaminate.decontaminate(d, benchmark))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose them are replaced in the texts; n_chars follows."""
    clean = pii.sanitised(docs)
    length = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", length).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text, decodes it again, and returns the digests of both."""
    import public_tokenizers

    return bpe.digests(bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path(bpe.VOCABULARY)))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: A fitted model, signatures and merges by rank have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written on its way goes once its result is written."""
    docs = common.table(spark, sf_dir, "documents")
    before = common.made()
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for path in [p for p in common.made() if p not in before][:-1]:
            common.delete(spark, path)
    return docs
