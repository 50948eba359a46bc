"""How the driver's tables play the library's roles, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import epoch_micros, epoch_seconds
from ..session import table


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        key.alias("transaction_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount"),
        F.when(key % 50 == 0, "EUR").otherwise("USD").alias("currency"),
        F.when(key % 7 != 0, F.concat(F.lit("REF-"), key.cast("string"))).alias("reference_id"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_linenumber").cast("string"), part.cast("string"), F.col("l_suppkey").cast("string")).alias("ledger_id"),
        F.col("l_orderkey").alias("transaction_id"), F.col("l_extendedprice").alias("posted_amount"),
        F.when(part % 40 == 0, "EUR").otherwise("USD").alias("currency"), F.col("l_shipdate").alias("posting_ts"),
        F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "pending").otherwise("settled").alias("status"),
        F.when(part % 9 == 0, None).when(part % 11 == 0, "REF-OTHER").otherwise(F.concat(F.lit("REF-"), F.col("l_orderkey").cast("string"))).alias("reference_id"),
    )


TX = """tx AS (SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderdate AS ts, o_totalprice AS amount,
  CASE WHEN o_orderkey % 50 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'REF-' || CAST(o_orderkey AS VARCHAR) END AS reference_id FROM orders)"""
LEDGER = """led AS (SELECT CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS ledger_id,
  l_orderkey AS transaction_id, l_extendedprice AS posted_amount, CASE WHEN l_partkey % 40 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  l_shipdate AS posting_ts, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'settled' END AS status,
  CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN 'REF-OTHER' ELSE 'REF-' || CAST(l_orderkey AS VARCHAR) END AS reference_id FROM lineitem)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a customer's history: the key in props is the counterparty, the event type its country."""
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("customer"), epoch_seconds(ts).alias("t"), epoch_micros(ts).alias("micros"),
        F.col("event_id").alias("pos"), F.col("value").alias("amount"), F.get_json_object("props", "$.k").alias("counterparty"),
        F.col("event_type").alias("country"), (F.hour(ts) + F.minute(ts) / 60.0).alias("hour"),
    )


HISTORY = """h AS (SELECT event_id AS transaction_id, user_id AS customer, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t, epoch_us(ts) AS micros,
  event_id AS pos, value AS amount, json_extract_string(props, '$.k') AS counterparty, event_type AS country,
  hour(ts) + minute(ts) / 60.0::double AS hour FROM events)"""


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


class Slate:
    """Queries and their SQL, by name."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
