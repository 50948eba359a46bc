"""Rule reconciliation of transactions with ledger postings.

One shuffle brings each transaction's postings down to the earliest one and
their number (partial aggregation, so a transaction with very many postings is
no hot task); the rules are column expressions over that row.

transactions: transaction_id, customer_id, ts, amount, currency, reference_id
ledger: ledger_id, transaction_id, posted_amount, currency, posting_ts, status, reference_id
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cents, epoch_seconds

DAY = 86_400
#: Defaults of the rules: cents of tolerance, shares for severities, days.
CONFIG = {"tolerance_cents": 1, "high_share": 0.10, "medium_share": 0.01, "late_days": 3, "very_late_factor": 3, "stale_days": 3, "status_rules": True}


def matched(transactions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each transaction with its earliest posting (`p`, null without one) and `n_postings`."""
    order = ["posting_ts", "ledger_id", "posted_amount", "currency", "status", "reference_id"]
    earliest = ledger.groupBy("transaction_id").agg(F.min(F.struct(*order)).alias("p"), F.count(F.lit(1)).alias("n_postings"))
    return transactions.join(earliest, "transaction_id", "left").fillna(0, ["n_postings"])


def _finding(rule: str, field: str, severity: Column | str, when: Column, difference: Column | None = None) -> Column:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    amount = F.lit(None).cast("double") if difference is None else difference.cast("double")
    return F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(field).alias("field"), level.alias("severity"), amount.alias("difference")))


def rules(config: dict, as_of: Column | None) -> list[Column]:
    """The ten rules in order; each is a finding or null."""
    has = F.col("p").isNotNull()
    off = cents(F.col("amount")) - cents(F.col("p.posted_amount"))
    share = F.abs(off) / F.greatest(F.abs(cents(F.col("amount"))), F.lit(1))
    size = F.when(share >= config["high_share"], "high").when(share >= config["medium_share"], "medium").otherwise("low")
    lag = epoch_seconds(F.col("p.posting_ts")) - epoch_seconds(F.col("ts"))
    late = config["late_days"] * DAY
    mine, theirs = F.col("reference_id"), F.col("p.reference_id")
    out = [
        _finding("REC-001", "ledger_record", "high", ~has),
        _finding("REC-002", "posting_count", "high", F.col("n_postings") > 1, F.col("n_postings")),
        _finding("REC-003", "amount", size, has & (F.abs(off) > config["tolerance_cents"]), off / 100),
        _finding("REC-004", "currency", "high", has & (F.col("currency") != F.col("p.currency"))),
        _finding("REC-005", "reference_id", "medium", has & (mine.isNull() != theirs.isNull())),
        _finding("REC-006", "reference_id", "high", has & mine.isNotNull() & theirs.isNotNull() & (mine != theirs)),
        _finding("REC-007", "posting_ts", "high", has & (lag < 0), lag),
        _finding("REC-008", "posting_ts", F.when(lag > late * config["very_late_factor"], "high").otherwise("medium"), has & (lag > late), lag),
    ]
    if config["status_rules"]:
        out.append(_finding("REC-009", "status", "medium", has & (F.col("p.status") == "failed")))
        if as_of is not None:
            age = epoch_seconds(as_of) - epoch_seconds(F.col("ts"))
            out.append(_finding("REC-010", "status", "medium", has & (F.col("p.status") == "pending") & (age > config["stale_days"] * DAY), age))
    return out


def reconcile(transactions: DataFrame, ledger: DataFrame, as_of: Column | None = None, extra: tuple[Callable[[], Column], ...] = (), **config) -> DataFrame:
    """Each transaction with findings (array, by rule) and status reconciled or discrepancy.

    extra holds further rules: functions that return a finding column.
    """
    found = [*rules(CONFIG | config, as_of), *(rule() for rule in extra)]
    rows = matched(transactions, ledger).withColumn("findings", F.array_compact(F.array(*found)))
    return rows.withColumn("status", F.when(F.size("findings") > 0, "discrepancy").otherwise("reconciled"))


def findings(reconciled: DataFrame) -> DataFrame:
    return reconciled.select("transaction_id", "customer_id", F.explode("findings").alias("f")).select("transaction_id", "customer_id", "f.*")


def reconcile_cases(cases: DataFrame, transactions: DataFrame, ledger: DataFrame, **config) -> DataFrame:
    """The transactions of cases (case_id, transaction_id, as_of), the focus and its context, each judged at its case's time."""
    focus = cases.select("case_id", "as_of", "transaction_id").join(transactions, "transaction_id")
    return reconcile(focus, ledger, F.col("as_of"), **config)


def with_postings(transactions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each transaction with all its postings as one sorted array, empty without any.

    A transaction's postings are few; one with very many should be read from the ledger itself.
    """
    columns = [c for c in ledger.columns if c != "transaction_id"]
    nested = ledger.groupBy("transaction_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("postings"))
    return transactions.join(nested, "transaction_id", "left").withColumn("postings", F.coalesce("postings", F.array()))
