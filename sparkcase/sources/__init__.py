"""Readers and writers of the tables, labels, reports and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = {"customers": "customers.csv", "kyc_records": "kyc_records.csv", "transactions": "transactions.csv", "ledger": "ledger.csv"}


def read_raw(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV of strings, every cell as it is (line ends within quotes too), with _row_number from 1, over files in order of name.

    A file of quoted line ends cannot be split, so a file is one task, in which
    its rows keep their order. Files that are too large for that should come as several.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    rows = rows.withColumns({"__file": F.input_file_name(), "__at": F.monotonically_increasing_id()})
    # Ids ascend within a file's one task; what is summed in one order is a row a file.
    files = rows.groupBy("__file").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = files.select("__file", "__first", before.alias("__before"))
    return rows.join(first, "__file").withColumn("_row_number", F.col("__at") - F.col("__first") + 1 + F.col("__before")).drop("__file", "__at", "__first", "__before")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV whose empty strings stay empty strings."""
    return spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of the files in a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: DataFrame | None) -> bool | None:
    """True if all files have the expected (file, sha256), None without expectations; else an error."""
    if expected is None:
        return None
    wrong = expected.alias("e").join(checksums(spark, path).alias("f"), "file", "left").filter(~F.col("e.sha256").eqNullSafe(F.col("f.sha256")))
    names = [r["file"] for r in wrong.select("file").limit(5).collect()]
    if names:
        raise ValueError(f"files differ from the manifest: {', '.join(names)}")
    return True


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV with header; nested columns become JSON text."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c) for c in df.columns]
    df.select(flat).write.mode("overwrite").option("header", True).csv(path)


def write_dataset(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as CSV, and a manifest (table, file, sha256) of what was written, itself written as JSON."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")
        parts.append(checksums(spark, f"{path}/{name}/*.csv").select(F.lit(name).alias("table"), "file", "sha256"))
    manifest = parts[0]
    for p in parts[1:]:
        manifest = manifest.unionByName(p)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Appends changed rows to a table and returns its current rows: the latest version of each key."""
    changes.write.mode("append").parquet(path)
    rows = spark.read.parquet(path)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), version).alias("x"))
    return newest.select(key, "x.*")


#: Buckets of a merged table: a change rewrites those that it touches.
BUCKETS = 64


def current(spark: SparkSession, path: str, touched: list[int] | None = None) -> DataFrame | None:
    """The rows of a table that merge() keeps: of each bucket (or of these buckets), its newest generation; null if nothing has been merged yet."""
    places = _places(spark, path)
    if places is None:
        return None
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows if touched is None else rows.filter(F.col("bucket").isin(touched))
    return rows.join(F.broadcast(places.select("bucket", "generation")), ["bucket", "generation"], "left_semi").drop("bucket", "generation")  # a row a bucket


def _places(spark: SparkSession, path: str) -> DataFrame | None:
    """(bucket, generation) of the newest version of the table of places."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/places")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return None
    every = spark.read.schema("bucket int, generation int, version int").parquet(f"{path}/places")
    return every.filter(F.col("version") == every.agg(F.max("version")).head()[0]).select("bucket", "generation", "version")


def merge(spark: SparkSession, path: str, changes: DataFrame, key: str, version: str, buckets: int = BUCKETS) -> DataFrame:
    """Merges changed rows into a table and returns its current rows: the greatest version of each key.

    Only buckets (by hash of the key) that hold a changed key are read and written anew, as a new generation; a small table of
    places then says which generation of each bucket counts, so readers see the old rows until it is there, and a failed merge
    leaves nothing behind but files that no one reads. The number of buckets stays that of the first merge. Null is a key.
    Equal versions of a key: the greatest row by its columns in order.
    """
    old = _places(spark, path)
    held = [] if old is None else old.collect()  # a row a bucket
    n = len(held) or buckets
    place = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    touched = sorted(r[0] for r in changes.select(place).distinct().collect())  # a number a bucket
    if touched or not held:
        last = max((r["version"] for r in held), default=0)
        rows = changes if old is None else changes.unionByName(current(spark, path, touched), allowMissingColumns=True)
        others = [c for c in rows.columns if c != key]
        newest = rows.groupBy(key).agg(F.max(F.struct(version, *[c for c in others if c != version])).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in others])
        newest.withColumns({"generation": F.lit(last + 1), "bucket": place}).repartition("bucket").write.mode("append").partitionBy("generation", "bucket").parquet(f"{path}/rows")
        generations = {r["bucket"]: r["generation"] for r in held} or dict.fromkeys(range(n), 0)
        places = [(b, last + 1 if b in touched else g, last + 1) for b, g in generations.items()]
        spark.createDataFrame(places, "bucket int, generation int, version int").coalesce(1).write.mode("append").parquet(f"{path}/places")
    return current(spark, path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small report table as Markdown."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(["" if v is None else v for v in r]) for r in rows)])
