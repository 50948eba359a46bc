"""What was known at each event: the latest state of several kinds at or before its time, in one shuffle.

Events and states are one sorted sequence a key; at an event, the last state of each
kind that has come by. A state of the event's own time counts. Of states of one key
and time the greatest (by its columns in order) stands for all. Events or states
without a key or time: such events keep null states, such states are never met.
Events that repeat are kept, each with its states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(events: DataFrame, states: dict[str, DataFrame], key: str, time: str) -> DataFrame:
    """events with a column a kind of state: a struct of its columns other than key and time, with `at`, its time; null if there was none.

    Each table of states has the columns key and time under these names.
    """
    row = F.struct(*[F.col(c) for c in events.columns])
    valid = F.col(key).isNotNull() & F.col(time).isNotNull()
    kinds = {}
    for name, df in states.items():
        others = [c for c in df.columns if c not in (key, time)]
        one = df.filter(valid).groupBy(key, time).agg(F.max(F.struct(*others)).alias("s"))
        kinds[name] = one.select(key, time, F.struct(F.col(time).alias("at"), *[F.col(f"s.{c}").alias(c) for c in others]).alias(name))
    every = events.filter(valid).select(key, time, F.lit(1).alias("__side"), row.alias("__event"))
    for df in kinds.values():
        every = every.unionByName(df.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = every.withColumns({n: F.last(n, ignorenulls=True).over(so_far) for n in kinds}).filter("__side = 1")
    out = met.select("__event.*", *kinds)
    return out.unionByName(events.filter(~F.coalesce(valid, F.lit(False))), allowMissingColumns=True)


def customer_view(transactions: DataFrame, findings: DataFrame, scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """The transactions of customers in time with their own findings and score, and the customer's latest case decision by then.

    transactions: (customer_id, ts, transaction_id, ...); findings: (transaction_id, rule_id, severity); scores: (transaction_id,
    score); decisions: (customer_id, ts, decision). Findings come as n_findings and details, the different rules with their severity.
    """
    found = findings.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_findings"), F.array_sort(F.collect_set(F.struct("rule_id", "severity"))).alias("details"))
    rows = transactions.join(found, "transaction_id", "left").join(scores.select("transaction_id", "score"), "transaction_id", "left").fillna(0, ["n_findings"])
    return as_of(rows, {"decision": decisions.select("customer_id", "ts", "decision")}, "customer_id", "ts").withColumns(
        {"decided_at": F.col("decision.at"), "decision": F.col("decision.decision")})
