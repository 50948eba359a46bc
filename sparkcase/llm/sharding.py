"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Every record is hashed by its id into one of thousands of virtual slots. Bytes
and rows are summed per slot, and a map assigns each slot to a shard: heaviest
slot first, each to the shard with the fewest bytes so far. The map is a table
(version, vslot, shard, bytes, rows); rebalancing writes its next version and
moves only the slots it must. Everything is DataFrame and SQL expressions.

The number of slots is fixed, so the map is bounded (4,096 rows by default) and
may be broadcast however much data there is. A hot source or group of equal
texts does no harm, as only the id decides the slot. Places within a slot are
numbered in SUBSLOTS parts (by a hash of the whole record), so that neither a
slot nor a repeated id is one task: the sizes of all parts are a bounded table.

Nulls: a null text has 0 bytes and the checksum of an empty text. Rows of null
id are dealt by their texts. Repeated rows each get their own place; only equal
rows of one id share a part. An empty table gives an empty result. Columns named
like the outputs are replaced, others are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, table

SLOTS = 4096
SHARDS = 24
OVERHEAD_BYTES = 8
LAW = "bytes"
SUBSLOTS = 16


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """df's id with the record's size, its text's checksum and its virtual slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), text)))
    return df.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(OVERHEAD_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_stats(rows: DataFrame, slots: int | None = None) -> DataFrame:
    """Bytes and rows of each virtual slot that has any; with slots, of all of these, so that a map of them can place any later record."""
    stats = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    if slots is None:
        return stats
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(stats, "vslot", "left").fillna(0, ["bytes", "rows"])


def build_map(stats: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the slot-to-shard map.

    The greedy rule is sequential, so it runs as one SQL fold over the bounded
    array of slots: heaviest first (ties: smaller slot), each to the shard with
    the fewest bytes (ties: smaller shard).
    """
    heaviest = F.array_sort(
        F.collect_list(F.struct((-F.col("bytes")).alias("order"), F.col("vslot"), F.col("bytes"), F.col("rows")))
    )
    start = f"named_struct('load', array_repeat(0L, {shards}), 'to', cast(array() as array<int>))"
    step = """(a, s) -> named_struct(
        'load', transform(a.load, (v, i) -> if(i = array_position(a.load, array_min(a.load)) - 1, v + s.bytes, v)),
        'to', array_append(a.to, cast(array_position(a.load, array_min(a.load)) - 1 as int)))"""
    return (
        stats.groupBy()
        .agg(heaviest.alias("slots"))
        .withColumn("to", F.expr(f"aggregate(slots, {start}, {step}).to"))
        .select(F.explode(F.arrays_zip("slots", "to")).alias("x"))
        .select(
            F.lit(1).alias("version"), F.col("x.slots.vslot").alias("vslot"), F.col("x.to").alias("shard"),
            F.col("x.slots.bytes").alias("bytes"), F.col("x.slots.rows").alias("rows"),
        )
    )


def grow_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for shards + 1 shards.

    Slots move only into the new shard: each old shard gives up its lightest
    slots as long as it stays at or above the new fair share.
    """
    fair = F.sum("bytes").over(Window.partitionBy("version")) / F.lit(shards + 1)
    lightest = Window.partitionBy("version", "shard").orderBy("bytes", "vslot")
    given = F.sum("bytes").over(lightest.rowsBetween(Window.unboundedPreceding, 0))
    load = F.sum("bytes").over(Window.partitionBy("version", "shard"))
    return slot_map.withColumn("moves", load - given >= fair).select(
        (F.col("version") + 1).alias("version"), "vslot",
        F.when(F.col("moves"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"), "bytes", "rows",
    )


def write_map(slot_map: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """Appends a version of a map to its table and reads that version back; a version that is known need not be looked up."""
    spark = slot_map.sparkSession
    version = version or slot_map.agg(F.max("version")).first()[0]
    if version is None:  # a map of an empty table
        return slot_map
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return read_map(spark, path, version)


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    """One version of a map's table: the latest by default."""
    table_ = spark.read.parquet(path).select("version", "vslot", "shard", "bytes", "rows")
    if version is None:
        version = table_.agg(F.max("version")).first()[0]
    return table_.filter(F.col("version") == version)


def rebalance(rows: DataFrame, path: str, shards: int) -> DataFrame:
    """Writes the next version of the map at path, for one shard more and the sizes that rows have now; returns it."""
    latest = read_map(rows.sparkSession, path)
    now = latest.select("version", "vslot", "shard").join(slot_stats(rows), "vslot", "left").fillna(0, ["bytes", "rows"])
    return write_map(grow_map(now, shards), path)


def assign(rows: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with shard and slot, the row's gapless place in its shard.

    Places run by virtual slot, then part. The window covers one part of a
    virtual slot at a time; the places before it are sums over a bounded table
    of at most SUBSLOTS counts a slot.
    """
    part = F.pmod(F.xxhash64(id_col, "size", "text_crc32"), F.lit(SUBSLOTS)).cast("int")
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("vslot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("vslot", "part").orderBy(id_col, "size", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(bases), ["vslot", "part"])  # at most SLOTS * SUBSLOTS rows
        .withColumn("slot", (F.col("base") + F.col("place")).cast("long"))
        .drop("base", "place", "part")
    )


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Each record's id, size, checksum, virtual slot, shard and place, and next_shard, its shard once there is one more.

    Both versions of the map are kept as a table: the second is the edit that a rebalancing makes.
    """
    rows = measured(df, id_col, text_col, slots)
    path = fresh_path(df.sparkSession, "slotmap")
    first = write_map(build_map(slot_stats(rows, slots), shards), path, 1)
    second = write_map(grow_map(first, shards), path, 2)
    later = F.broadcast(second.select("vslot", F.col("shard").cast("int").alias("next_shard")))  # at most SLOTS rows
    return assign(rows, first, id_col).join(later, "vslot")


def op10_sharding(spark, sf_dir):
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "next_shard",
    )
