"""The batch pipeline: clean, validate, normalise, check references, consolidate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import address_parts, document_number, name_parts, pipe_list
from .quality import ROW, SCHEMAS, action_counts, cleaned, quarantined, referential, validated


@dataclass
class Consolidated:
    customers: DataFrame
    kyc_records: DataFrame
    transactions: DataFrame
    ledger: DataFrame
    quarantine: DataFrame
    actions: DataFrame
    duplicates: DataFrame


def canonical_customers(customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers with name, alternates and address in parts; those without a usable name are quarantined."""
    rows = customers.withColumns({
        "name_parts": name_parts(F.col("name")), "address_parts": address_parts(F.col("address")),
        "alternates": F.filter(F.transform(pipe_list(F.col("alternate_names")), lambda a: name_parts(a, unicode=False)), lambda p: F.size(p["tokens"]) > 0),
    })
    usable = F.size("name_parts.tokens") > 0
    bad = rows.filter(~usable).drop("name_parts", "address_parts", "alternates")
    return rows.filter(usable), quarantined(bad, "customers", "normalization_failed", F.lit("name"))


def canonical_kyc(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = records.withColumns({
        "name_parts": name_parts(F.col("name")), "address_parts": address_parts(F.col("address")), "number": document_number(F.col("document_number")),
    })
    usable = (F.size("name_parts.tokens") > 0) & F.col("number").isNotNull()
    bad = rows.filter(~usable).drop("name_parts", "address_parts", "number")
    return rows.filter(usable), quarantined(bad, "kyc_records", "normalization_failed")


def run(raw: dict[str, DataFrame]) -> Consolidated:
    """raw: the four tables as strings, each with a _row_number. All outputs are lazy.

    Customers that are rejected make their rows orphans, and rejected
    transactions make their postings orphans.
    """
    accepted, quarantine, actions, duplicates = {}, [], [], []
    for name, schema in SCHEMAS.items():
        actions.append(action_counts(raw[name], name))
        good, bad, same = validated(cleaned(raw[name]), schema)
        accepted[name] = good
        quarantine.append(bad)
        duplicates.append(same.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n"))
    customers, bad = canonical_customers(accepted["customers"])
    quarantine.append(bad)
    kyc, bad = canonical_kyc(accepted["kyc_records"])
    quarantine.append(bad)
    kyc, lost = referential(kyc, customers, "customer_id", "kyc_records")
    quarantine.append(lost)
    transactions, lost = referential(accepted["transactions"], customers, "customer_id", "transactions")
    quarantine.append(lost)
    ledger, lost = referential(accepted["ledger"], transactions, "transaction_id", "ledger")
    quarantine.append(lost)

    def united(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return Consolidated(*[d.drop(ROW) for d in (customers, kyc, transactions, ledger)], united(quarantine), united(actions), united(duplicates))


def report(c: Consolidated) -> DataFrame:
    """(measure, table, n): accepted rows, quarantine by reason, unparsed addresses, transactions without or with several postings."""
    def count(df: DataFrame, measure: str, table: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(measure).alias("measure"), F.lit(table).alias("table"), "n")

    parts = [count(getattr(c, t), "accepted", t) for t in SCHEMAS]
    parts.append(c.quarantine.groupBy("table", "reason").agg(F.count(F.lit(1)).alias("n")).select(F.col("reason").alias("measure"), "table", "n"))
    parts.append(count(c.customers.filter(~F.col("address_parts.parsed")), "unparsed_address", "customers"))
    parts.append(count(c.transactions.join(c.ledger, "transaction_id", "left_anti"), "without_ledger", "transactions"))
    parts.append(count(c.ledger.groupBy("transaction_id").count().filter("count > 1"), "multi_posted", "ledger"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cases(customers: DataFrame, documents: DataFrame, transactions: DataFrame, focus: DataFrame, days: int = 90) -> DataFrame:
    """One row per focus transaction: customer, documents, and the context before it, as sorted arrays.

    The context holds the customer's transactions of the last `days`, both ends inside, the focus left out.
    """
    chosen = focus.select("customer_id", F.col("transaction_id").alias("focus_id"), F.col("ts").alias("as_of"))
    near = transactions.select("customer_id", "transaction_id", "ts", "amount").join(chosen, "customer_id")
    near = near.filter((F.col("transaction_id") != F.col("focus_id")) & F.col("ts").between(F.col("as_of") - F.make_interval(days=F.lit(days)), F.col("as_of")))
    context = near.groupBy("focus_id").agg(F.array_sort(F.collect_list(F.struct("ts", "transaction_id", "amount"))).alias("context"))
    papers = documents.groupBy("customer_id").agg(F.array_sort(F.collect_list("document_id")).alias("documents"))
    rows = chosen.join(customers, "customer_id").join(papers, "customer_id", "left").join(context, "focus_id", "left")
    return rows.withColumns({
        "documents": F.coalesce("documents", F.array().cast(papers.schema["documents"].dataType)),
        "context": F.coalesce("context", F.array().cast(context.schema["context"].dataType)),
    })


def latest(transactions: DataFrame) -> DataFrame:
    """Each customer's latest transaction (ties: larger id), by partial maximum."""
    columns = [c for c in transactions.columns if c not in ("customer_id", "ts", "transaction_id")]
    newest = transactions.groupBy("customer_id").agg(F.max(F.struct("ts", "transaction_id", *columns)).alias("x"))
    return newest.select("customer_id", "x.*")


def masked(df: DataFrame, private: Column | str, allowed: bool) -> DataFrame:
    """df with a private column only where the role allows it."""
    return df if allowed else df.drop(private)
