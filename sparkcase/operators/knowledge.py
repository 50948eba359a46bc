"""Knowledge documents: load, front matter, sections, chunks, index."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.injection import injection_flags
from ..functions.text import clean_document, sentences, slug, squeeze_ends

MAX_BYTES = 1_000_000
REQUIRED = ("document_id", "title", "version", "source", "effective_date")
MAX_WORDS, OVERLAP_WORDS, MIN_WORDS = 120, 20, 15


def load(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("md", "txt")) -> tuple[DataFrame, DataFrame]:
    """(documents: path, trust, text; rejected: path, reason) of a folder, by the binaryFile source, in order of path.

    Links that lead out of the folder are rejected; only a local folder has links.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    outside = _outside(root)
    leaves = F.col("path").isin(*outside) if outside else F.lit(False)
    suffix = F.lower(F.substring_index("path", ".", -1))
    reason = (
        F.when(leaves, "outside_folder").when(~suffix.isin(*suffixes), "unsupported_type").when(F.col("length") > MAX_BYTES, "too_large")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8")
    )
    seen = files.withColumn("reason", reason)
    trust = F.when(F.col("path").rlike("/(untrusted|external)/"), "untrusted").otherwise("trusted")
    good = seen.filter("reason is null").select("path", trust.alias("trust"), F.decode("content", "UTF-8").alias("text"))
    return good.orderBy("path"), seen.filter("reason is not null").select("path", "reason").orderBy("path")


def _outside(root: str) -> list[str]:
    """The files under a local folder, as the binaryFile source names them, that are links out of it."""
    base = Path(root.removeprefix("file:"))
    if not base.is_dir():
        return []
    inside = base.resolve()
    return [f"file:{p}" for p in base.rglob("*") if p.is_symlink() and not p.resolve().is_relative_to(inside)]


def front_matter(text: Column) -> Column:
    """struct<meta map, body>; meta is null without the five required keys."""
    pattern = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"
    lines = F.filter(F.split(F.regexp_extract(text, pattern, 1), "\n"), lambda s: s.rlike(r"^\s*\w+\s*:"))
    entries = F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)), F.trim(F.regexp_replace(s, "^[^:]*:", ""))))
    keys = F.transform(entries, lambda e: e["col1"])
    unique = F.filter(entries, lambda e, i: F.array_position(keys, e["col1"]) == i + 1)
    meta = F.map_from_entries(unique)
    complete = F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)) == 0
    return F.struct(F.when(complete, meta).alias("meta"), F.regexp_extract(text, pattern, 2).alias("body"))


def sections(documents: DataFrame, body: str = "body") -> DataFrame:
    """(document_id, section_index, title, section_id, text): cut at `## ` lines; repeated titles get -2, -3..."""
    parts = F.split(F.concat(F.lit("\n"), F.col(body)), r"\n## ")
    rows = documents.select("document_id", F.posexplode(parts).alias("section_index", "part"))
    title = F.when(F.col("section_index") == 0, F.lit("Introduction")).otherwise(squeeze_ends(F.substring_index("part", "\n", 1)))
    text = F.when(F.col("section_index") == 0, F.regexp_replace("part", r"(?m)^# .*$", "")).otherwise(
        F.when(F.contains("part", F.lit("\n")), F.regexp_replace("part", r"^[^\n]*\n", "")).otherwise("")
    )
    rows = rows.select("document_id", "section_index", title.alias("title"), squeeze_ends(text).alias("text")).filter("text <> ''")
    base = slug(F.col("title"))
    nth = F.row_number().over(Window.partitionBy("document_id", "base").orderBy("section_index"))
    return rows.withColumn("base", base).withColumn("nth", nth).select(
        "document_id", "section_index", "title", "text",
        F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("nth").cast("string"))).alias("section_id"),
    )


def packed(units: list[str], most: int = MAX_WORDS, overlap: int = OVERLAP_WORDS, least: int = MIN_WORDS) -> list[str]:
    """Sentences in order into chunks of at most `most` words, each begun by up to `overlap` words of whole sentences."""
    sizes = [len(u.split()) for u in units]
    out: list[list[int]] = []
    held: list[int] = []
    total = 0
    for i, n in enumerate(sizes):
        if held and total + n > most:
            out.append(held)
            kept = 0
            carry = 0
            while kept < len(held) and carry + sizes[held[-1 - kept]] <= overlap:
                carry += sizes[held[-1 - kept]]
                kept += 1
            held, total = held[len(held) - kept :], carry
        held = [*held, i]
        total += n
    if held:
        out.append(held)
    chunks = [[units[i] for i in c] for c in out]
    if len(chunks) > 1 and sum(len(u.split()) for u in chunks[-1]) < least:
        tail = chunks.pop()
        chunks[-1] += [u for u in tail if u not in chunks[-1]]
    return [" ".join(c) for c in chunks]


@F.pandas_udf(ArrayType(StringType()))
def _packed(units: pd.Series) -> pd.Series:
    return units.map(lambda u: None if u is None else packed(list(u)))


def chunks(parts: DataFrame) -> DataFrame:
    """Sections in chunks: chunk_id, embed_text and injection flags. The greedy packing of sentences is an Arrow UDF."""
    rows = parts.withColumn("units", sentences(F.col("text"))).select(
        "document_id", "section_id", "title", F.posexplode(_packed("units")).alias("chunk_index", "text")
    )
    return rows.select(
        F.concat_ws(":", "document_id", "section_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "section_id", "title",
        "chunk_index", "text", F.concat("title", F.lit(". "), "text").alias("embed_text"), injection_flags(F.col("text")).alias("flags"),
    )


def cleaned(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.withColumn(text, clean_document(F.col(text)))


def write_index(rows: DataFrame, path: str, model: str) -> DataFrame:
    """Writes chunks and a one-row manifest (n, model, digest); repeated chunk ids are an error."""
    again = rows.groupBy("chunk_id").count().filter("count > 1").limit(1)
    if not again.isEmpty():
        raise ValueError("chunk ids repeat")
    rows.write.mode("overwrite").parquet(f"{path}/chunks")
    kept = rows.sparkSession.read.parquet(f"{path}/chunks")
    manifest = kept.agg(F.count(F.lit(1)).alias("n"), F.lit(model).alias("model"), F.sum(F.xxhash64("chunk_id", "text").cast("decimal(38,0)")).alias("digest"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return kept


def open_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The chunks of an index, if its manifest names this model and their number and digest."""
    kept, said = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/manifest").first()
    now = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("chunk_id", "text").cast("decimal(38,0)"))).first()
    if (said["model"], said["n"], said["digest"]) != (model, now[0], now[1]):
        raise ValueError("the index does not fit its manifest")
    return kept
