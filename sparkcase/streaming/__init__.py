"""Incremental forms of the batch operators (extensions), on Structured Streaming.

Event times have to be TIMESTAMP for a watermark; cast TIMESTAMP_NTZ first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconciled(transactions: DataFrame, postings: DataFrame, delay: str = "1 day", days: int = 3) -> DataFrame:
    """Transactions left-joined with postings within `days` after them; unmatched ones appear when the watermark passes."""
    left = transactions.withWatermark("ts", delay).alias("t")
    right = postings.withWatermark("posting_ts", delay).alias("p")
    near = F.expr(f"t.transaction_id = p.transaction_id and p.posting_ts >= t.ts and p.posting_ts <= t.ts + interval {days} days")
    return left.join(right, near, "leftOuter").select(
        "t.transaction_id", "t.ts", "t.amount", "p.posting_ts", "p.posted_amount",
        F.when(F.col("p.transaction_id").isNull(), "REC-001").when(F.abs(F.rint(F.col("t.amount") * 100) - F.rint(F.col("p.posted_amount") * 100)) > 1, "REC-003").alias("rule_id"))


def velocity(events: DataFrame, window: str = "10 minutes", slide: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per customer in sliding windows (near the trailing counts, not equal to them)."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "customer")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).select("window.start", "window.end", "customer", "n", "amount")


def band_windows(events: DataFrame, low: float = 9_000.0, high: float = 10_000.0, window: str = "30 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Just-below-threshold amounts per customer and currency in sliding windows, from three on."""
    inside = (F.col("amount") >= low) & (F.col("amount") < high)  # counted, not filtered, so that other rows move the watermark
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "customer", "currency").agg(F.count_if(inside).alias("n"))
    return rows.filter("n >= 3").select("window.start", "window.end", "customer", "currency", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "customer")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "customer", "n")


def deduplicated(events: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
