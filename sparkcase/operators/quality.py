"""Cleaning, typed validation, de-duplication and referential checks, with quarantine.

A schema is a list of fields: name, SQL type and checks. Rejected rows go to one
quarantine table (table, row number, reason, detail, record as JSON).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell_actions, clean_cell

ROW = "_row_number"


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = True
    values: tuple[str, ...] = ()
    pattern: str = ""
    check: str = ""  # a SQL condition over the typed fields


@dataclass(frozen=True)
class Schema:
    table: str
    key: str
    fields: tuple[Field, ...]
    rules: tuple[tuple[str, str], ...] = field(default=())  # (name, SQL condition over typed fields)


#: The four input tables.
SCHEMAS = {
    "customers": Schema("customers", "customer_id", (
        Field("customer_id"), Field("name", check="length(name) >= 1"), Field("alternate_names", required=False), Field("date_of_birth", "date"),
        Field("address"), Field("country", pattern="^[A-Z]{2}$"), Field("occupation"), Field("account_type", values=("personal", "business", "savings")),
        Field("account_open_date", "date"), Field("account_age_days", "int", check="account_age_days >= 0"),
        Field("kyc_status", values=("verified", "pending", "expired", "rejected")), Field("is_synthetic", "boolean", check="is_synthetic"))),
    "kyc_records": Schema("kyc_records", "document_id", (
        Field("document_id"), Field("customer_id"), Field("name"), Field("date_of_birth", "date"), Field("address"),
        Field("document_type", values=("passport", "national_id", "drivers_license")), Field("document_number"), Field("issue_date", "date"),
        Field("expiry_date", "date"), Field("is_synthetic", "boolean", check="is_synthetic")), (("expiry_date", "expiry_date > issue_date"),)),
    "transactions": Schema("transactions", "transaction_id", (
        Field("transaction_id"), Field("customer_id"), Field("timestamp", "timestamp_ntz"), Field("amount", "double", check="amount > 0"),
        Field("currency", pattern="^[A-Z]{3}$"), Field("transaction_type", values=("transfer_out", "transfer_in", "payment", "withdrawal", "deposit")),
        Field("sender"), Field("receiver"), Field("sender_country", pattern="^[A-Z]{2}$"), Field("receiver_country", pattern="^[A-Z]{2}$"),
        Field("channel", values=("mobile", "web", "branch", "atm", "pos")), Field("reference_id", required=False), Field("is_synthetic", "boolean", check="is_synthetic"))),
    "ledger": Schema("ledger", "ledger_id", (
        Field("ledger_id"), Field("transaction_id"), Field("posted_amount", "double"), Field("currency", pattern="^[A-Z]{3}$"),
        Field("posting_timestamp", "timestamp_ntz"), Field("settlement_status", values=("settled", "pending", "failed")),
        Field("reference_id", required=False), Field("is_synthetic", "boolean", check="is_synthetic"))),
}


def cleaned(raw: DataFrame, unicode: bool = True) -> DataFrame:
    return raw.select(*[clean_cell(F.col(c), unicode).alias(c) if c != ROW else F.col(c) for c in raw.columns])


def action_counts(raw: DataFrame, table: str) -> DataFrame:
    """(table, action, n): what cleaning did, in one pass over the cells."""
    cells = [cell_actions(F.col(c)) for c in raw.columns if c != ROW]
    sums = {a: sum((F.coalesce(x[a], F.lit(False)).cast("long") for x in cells), F.lit(0)) for a in cells[0]}
    row = raw.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()])
    return row.unpivot([], list(sums), "action", "n").select(F.lit(table).alias("table"), "action", "n")


def _typed(f: Field) -> Column:
    if f.type == "boolean":  # only the word true
        return F.when(F.lower(F.col(f.name)) == "true", True).when(F.col(f.name).isNotNull(), False)
    return F.col(f.name) if f.type == "string" else F.col(f.name).try_cast(f.type)


def _error(f: Field) -> Column:
    raw, typed = F.col(f.name), F.col(f"t.{f.name}")
    bad = raw.isNotNull() & typed.isNull()
    if f.required:
        bad = bad | raw.isNull()
    if f.values:
        bad = bad | ~typed.isin(*f.values)
    if f.pattern:
        bad = bad | ~typed.rlike(f.pattern)
    if f.check:
        bad = bad | ~F.expr(f.check.replace(f.name, f"t.{f.name}"))
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(f.name))


def quarantined(df: DataFrame, table: str, reason: Column | str, detail: Column | None = None) -> DataFrame:
    columns = [c for c in df.columns if c != ROW and not c.startswith("__")]
    return df.select(
        F.lit(table).alias("table"), F.col(ROW).cast("long").alias("row_number"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        (detail if detail is not None else F.lit(None).cast("string")).alias("detail"), F.to_json(F.struct(*columns)).alias("record"),
    )


def judged(rows: DataFrame, schema: Schema) -> DataFrame:
    """rows with __t (typed struct) and __reason (null: accepted; `exact_duplicate` rows are only dropped).

    The first row of a key claims it, even if that row then fails validation.
    """
    names = [f.name for f in schema.fields]
    # Rows without a key do not claim one: each is its own group, so that they are no single task.
    own = F.when(F.col(schema.key).isNull(), F.col(ROW))
    first = Window.partitionBy(schema.key, own).orderBy(ROW)
    same = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rows = rows.withColumn("__body", same).withColumns({"__rn": F.row_number().over(first), "__first": F.first("__body").over(first)})
    typed = rows.withColumn("t", F.struct(*[_typed(f).alias(f.name) for f in schema.fields]))
    rule = [F.when(~F.coalesce(F.expr(_qualified(c, names)), F.lit(True)), F.lit(n)) for n, c in schema.rules]
    wrong = F.coalesce(*[_error(f) for f in schema.fields], *rule, F.lit(None).cast("string"))
    reason = (
        F.when(F.col(schema.key).isNull(), "missing_primary_key")
        .when((F.col("__rn") > 1) & (F.col("__body") == F.col("__first")), "exact_duplicate")
        .when(F.col("__rn") > 1, "duplicate_key_conflict").when(wrong.isNotNull(), "schema_validation_failed")
    )
    return typed.withColumns({"__reason": reason, "__field": wrong}).withColumnRenamed("t", "__t").drop("__rn", "__first", "__body")


def _qualified(condition: str, names: list[str]) -> str:
    import re

    return re.sub(r"\b(" + "|".join(names) + r")\b", r"t.\1", condition)


def validated(rows: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted typed rows with their row number, quarantine, exact duplicates)."""
    seen = judged(rows, schema)
    good = seen.filter(F.col("__reason").isNull()).select(ROW, "__t.*")
    bad = seen.filter(F.col("__reason").isNotNull() & (F.col("__reason") != "exact_duplicate"))
    detail = F.when(F.col("__reason") == "schema_validation_failed", F.col("__field"))
    return good, quarantined(bad, schema.table, F.col("__reason"), detail), seen.filter(F.col("__reason") == "exact_duplicate")


def referential(rows: DataFrame, parents: DataFrame, key: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is among the parents, quarantine of the others)."""
    known = parents.select(key)
    return rows.join(known, key, "left_semi"), quarantined(rows.join(known, key, "left_anti"), table, "orphan_reference", F.lit(key))
