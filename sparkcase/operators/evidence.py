"""Evidence items of all cases in one schema, and what is assembled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["case_id", "evidence_id", "source", "description", "payload"]


def _items(df: DataFrame, evidence_id: Column, source: str, description: Column, payload: list[Column]) -> DataFrame:
    return df.select("case_id", evidence_id.alias("evidence_id"), F.lit(source).alias("source"), description.alias("description"), F.to_json(F.struct(*payload)).alias("payload"))


def transaction_evidence(tx: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", F.lit("Transaction of"), F.format_number("amount", 2), "currency")
    return _items(tx, F.concat(F.lit("TXN-"), "transaction_id"), "transaction", text, [F.col("transaction_id"), F.col("amount"), F.col("currency")])


def customer_evidence(customers: DataFrame) -> DataFrame:
    return _items(customers, F.concat(F.lit("KYC-"), "customer_id"), "kyc", F.lit("Customer record"), [F.col("customer_id"), F.col("country")])


def reconciliation_evidence(reconciled: DataFrame) -> DataFrame:
    """One item per finding, or a single OK item."""
    base = F.concat(F.lit("REC-"), F.col("transaction_id").cast("string"))
    found = reconciled.select("case_id", "transaction_id", F.explode("findings").alias("f"))
    bad = _items(found, F.concat_ws("-", base, "f.rule_id"), "reconciliation", F.concat_ws(" ", "f.rule_id", "f.field"), [F.col("f.rule_id"), F.col("f.severity"), F.col("f.field")])
    fine = reconciled.filter(F.size("findings") == 0)
    return bad.unionByName(_items(fine, F.concat(base, F.lit("-OK")), "reconciliation", F.lit("All compared fields agree"), [F.col("status")]))


def behaviour_evidence(behaviour: DataFrame) -> DataFrame:
    facts = ["n_prior", "typical_ratio", "n_10min", "n_24h", "counterparty_seen", "country_seen", "n_identical"]
    return _items(behaviour, F.concat(F.lit("BEH-"), F.col("transaction_id").cast("string")), "anomaly", F.lit("Behaviour against earlier activity"), [F.col(f) for f in facts])


def match_evidence(ranks: DataFrame) -> DataFrame:
    return _items(ranks, F.concat(F.lit("KYCM-"), F.col("query_id").cast("string")), "kyc", F.concat_ws(" ", F.lit("Own record rank"), F.col("own_rank").cast("string")), [F.col("own_rank"), F.col("own_score"), F.col("other_strong")])


def anomaly_evidence(scored: DataFrame) -> DataFrame:
    text = F.when(F.col("flagged"), "Anomaly score above the threshold").otherwise("Anomaly score below the threshold")
    return _items(scored, F.concat(F.lit("ANOM-"), F.col("transaction_id").cast("string")), "anomaly", text, [F.col("probability"), F.col("threshold"), F.col("flagged")])


def governance_evidence(scored: DataFrame) -> DataFrame:
    hit = scored.filter(F.col("new_cross_border") | F.col("structuring"))
    return _items(hit, F.concat(F.lit("ESG-"), F.col("transaction_id").cast("string")), "esg", F.lit("Governance signal"), [F.col("new_cross_border"), F.col("structuring"), F.col("n_band")])


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(COLUMNS))
    return out


def collisions(evidence: DataFrame) -> DataFrame:
    """Evidence ids that a case holds more than once."""
    return evidence.groupBy("case_id", "evidence_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def report(evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row a case: decision, findings and items by source, in order of their ids."""
    items = evidence.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("evidence_id", "source", "description"))).alias("items"), F.count(F.lit(1)).alias("n_items"))
    return decisions.join(items, "case_id", "left")


#: What may be asked about a finding: rule or driver to topic (fixed).
TOPICS = {
    "REC-001": "missing ledger record", "REC-002": "duplicate posting", "REC-003": "amount mismatch", "REC-004": "currency mismatch",
    "REC-005": "missing reference", "REC-006": "reference mismatch", "REC-007": "posted before transaction", "REC-008": "late posting",
    "REC-009": "failed settlement", "REC-010": "stale pending settlement",
}


def retrieval_queries(findings: DataFrame) -> DataFrame:
    """(case_id, queries): the topics of a case's rules, each once, in order."""
    topics = F.create_map(*[F.lit(x) for pair in TOPICS.items() for x in pair])
    rows = findings.withColumn("query", F.try_element_at(topics, F.col("rule_id"))).filter("query is not null")
    return rows.groupBy("case_id").agg(F.array_sort(F.collect_set("query")).alias("queries"))


def _payload(name: str, kind: str | None = None) -> Column:
    value = F.get_json_object("payload", f"$.{name}")
    return value.try_cast(kind) if kind else value


def _fixed(name: str, places: int) -> Column:
    return _payload(name, f"decimal(38,{places})").cast("string")


def statements(evidence: DataFrame) -> DataFrame:
    """(case_id, evidence_id, statement): what each kind of evidence states by its typed fields, as training targets.

    evidence: (case_id, evidence_id, source, description, payload as JSON). The kind follows from the id's prefix, the source
    and the fields that are there; kinds that state nothing (thin history, unknown payloads) have no row. All but the template's
    own words come from the payload, so a statement's numbers are those of its evidence.
    """
    return evidence.select("case_id", "evidence_id", _told().alias("statement")).filter("statement IS NOT NULL")


def _told() -> Column:
    e, text = F.col("evidence_id"), F.concat
    rank, others = _payload("own_record_rank", "int"), F.coalesce(F.size(F.from_json(_payload("other_strong_candidates"), "array<string>")), F.lit(0))
    own = F.when(rank > 0, text(F.lit("the customer's own record is at rank "), rank.cast("string"))).otherwise(F.lit("the customer's own record is not among the first candidates"))
    more = F.when(others > 0, text(F.lit("; other strong candidates: "), others.cast("string"))).otherwise(F.lit(""))
    verdict = F.when(_payload("flagged") == "true", F.lit("it flagged the transaction")).otherwise(F.lit("it did not flag the transaction"))
    return (
        F.when(e.startswith("KYCM-"), text(F.lit("For KYC document "), _payload("document_id"), F.lit(" "), own, more))
        .when(e.startswith("KYC-") & _payload("kyc_status").isNotNull(), text(F.lit("The KYC status is "), _payload("kyc_status"), F.lit("; the account has existed for "), _payload("account_age_days"), F.lit(" days")))
        .when((F.col("source") == "transaction") & _payload("amount").isNotNull(), text(
            F.lit("Transaction "), _payload("transaction_id"), F.lit(" is a "), _payload("type"), F.lit(" of "), _fixed("amount", 2), F.lit(" "), _payload("currency"), F.lit(" by "), _payload("channel")))
        .when(e.startswith("ANOM-"), text(F.lit("The anomaly score is "), _fixed("probability", 3), F.lit(" with alerts from "), _fixed("threshold", 3), F.lit("; "), verdict))
        .when(e.startswith("BEH-") & (_payload("prior_transactions", "int") >= 5), text(
            F.lit("The amount is "), _payload("typical_prior_amount_ratio"), F.lit(" times what was typical before, over "), _payload("prior_transactions"), F.lit(" transactions")))
        .when(e.startswith("REC-") & _payload("rule_id").isNotNull(), F.col("description"))
        .when(e.endswith("-OK"), text(F.lit("The transaction agrees with ledger record "), _payload("ledger_id")))
    )


def conclusions(evidence: DataFrame, floors: DataFrame) -> DataFrame:
    """(case_id, decision, summary, statement, cited): the closing inference of each case and what it rests on.

    floors: (case_id, floor, reasons), as engine_floor gives them. A case with a floor needs a person and cites the items that may
    have called for it; another one cites its first two records of reconciliation or transaction.
    """
    calls = F.col("evidence_id").startswith("KYCM-") | F.col("evidence_id").startswith("ANOM-") | (F.col("evidence_id").startswith("REC-") & _payload("rule_id").isNotNull())
    plain = F.col("evidence_id").startswith("REC-") | F.col("evidence_id").startswith("TXN")
    least = lambda condition: F.min(F.when(condition, F.col("evidence_id")))
    second = evidence.join(evidence.filter(plain).groupBy("case_id").agg(F.min("evidence_id").alias("first")), "case_id").filter(plain & (F.col("evidence_id") > F.col("first")))
    by_case = evidence.groupBy("case_id").agg(F.collect_set(F.when(calls, F.col("evidence_id"))).alias("calls"), least(plain).alias("first"), F.min("evidence_id").alias("any"))
    by_case = by_case.join(second.groupBy("case_id").agg(F.min("evidence_id").alias("second")), "case_id", "left").join(floors, "case_id", "left")
    review = F.col("floor").isNotNull()
    cited = F.when(review & (F.size("calls") > 0), F.array_sort("calls")).otherwise(F.array_compact(F.array(F.coalesce("first", "any"), F.when(~review, F.col("second")))))
    return by_case.select(
        "case_id", F.when(review, "REVIEW").otherwise("CLEAR").alias("decision"),
        F.when(review, F.concat(F.lit("For a person to look at: "), F.array_join(F.array_distinct("reasons"), "; "))).otherwise(F.lit("No check has found a problem.")).alias("summary"),
        F.when(review, F.lit("The checks call for a person's decision before this case is closed")).otherwise(F.lit("No check found a problem; on this evidence the transaction looks routine")).alias("statement"),
        F.transform(cited, lambda x: F.concat(F.lit("E:"), x)).alias("cited"))


def templated_findings(evidence: DataFrame) -> DataFrame:
    """A statement for each evidence item, as training targets: (case_id, statements); by its kind's fields where it has them, else its description."""
    plain = F.concat(F.initcap("source"), F.lit(": "), "description")
    text = F.coalesce(_told(), plain) if "payload" in evidence.columns else plain
    rows = evidence.select("case_id", "evidence_id", F.concat(text, F.lit(" [E:"), "evidence_id", F.lit("]")).alias("s"))
    return rows.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", "s"))), lambda x: x["s"]).alias("statements"))


#: What could end or open a part of a prompt.
_FENCE = r"(?i)<(?=\s*/?\s*(?:evidence|passages)\b)"


def fenced(text: Column) -> Column:
    """A text as data: no tag in it can open or close a part of a prompt."""
    return F.regexp_replace(text, _FENCE, "&lt;")


def prompt(statements: Column, passages: Column) -> Column:
    """The prompt of a case: evidence as fenced data, passages after it; neither can close its fence."""
    def part(name: str, lines: Column) -> Column:
        return F.concat(F.lit(f"<{name}>\n"), fenced(F.array_join(lines, "\n")), F.lit(f"\n</{name}>"))

    return F.concat(part("evidence", statements), F.lit("\n"), part("passages", passages))


def sampled(cases: DataFrame, group: str, per_group: int, seed: int) -> DataFrame:
    """per_group cases of each class in hash order: a sampling operator, the same for any partitioning."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.xxhash64("case_id", F.lit(seed)), "case_id")
    return cases.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_group).drop("n")


def sign_off(decisions: DataFrame) -> DataFrame:
    """decisions (case_id, seq, actor, action, comment) with `problem`: why a sign-off may not stand, or null.

    A case needs a comment for an override, and two different people for its approval.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("case_id").orderBy("seq")
    before = F.lag("actor").over(order)
    again = F.max(F.when(F.col("action") == "close", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return decisions.withColumn(
        "problem", F.when(again == 1, "already closed").when((F.col("action") == "override") & (F.coalesce(F.length("comment"), F.lit(0)) == 0), "an override needs a comment")
        .when((F.col("action") == "approve") & (before == F.col("actor")), "a second person has to approve"))


def case_pool(tx: DataFrame, problems: DataFrame, since: str | None = None, least_history: int = 10) -> DataFrame:
    """(transaction_id, customer_id, ts, category): transactions with more than so many earlier ones of their customer, from a time on.

    problems: (transaction_id, category); transactions without one are clean.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("customer_id").orderBy("ts", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = tx.withColumn("n_before", F.count(F.lit(1)).over(before)).filter(F.col("n_before") > least_history)
    rows = rows if since is None else rows.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    kinds = problems.groupBy("transaction_id").agg(F.min("category").alias("category"))
    return rows.join(kinds, "transaction_id", "left").select("transaction_id", "customer_id", "ts", F.coalesce("category", F.lit("clean")).alias("category"))


def one_a_customer(pool: DataFrame, banned: DataFrame, per_category: int, seed: int) -> DataFrame:
    """One case of each customer that is not banned (customer_id), and of these per_category of each category, in hash order."""
    from pyspark.sql import Window

    h = F.xxhash64("transaction_id", F.lit(seed))
    free = pool.join(banned.select("customer_id").distinct(), "customer_id", "left_anti").withColumn("h", h)
    one = free.groupBy("customer_id").agg(F.min_by(F.struct("transaction_id", "ts", "category", "h"), F.struct("h", "transaction_id")).alias("x")).select("customer_id", "x.*")
    order = Window.partitionBy("category").orderBy("h", "transaction_id")
    return one.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_category).drop("n", "h")


def training_set(cases: DataFrame, statements: DataFrame, passages: DataFrame, seed: int, held: float = 0.1) -> DataFrame:
    """(case_id, prompt, target, split): prompts from evidence and passages, template findings as targets, customers split by hash.

    cases: (case_id, customer_id); statements: as templated_findings gives them; passages: (case_id, passages).
    """
    rows = cases.join(statements, "case_id").join(passages, "case_id", "left")
    u = F.pmod(F.xxhash64("customer_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    none = F.array().cast("array<string>")
    return rows.select(
        "case_id", "customer_id", prompt(F.col("statements"), F.coalesce("passages", none)).alias("prompt"), F.to_json(F.struct(F.col("statements").alias("findings"))).alias("target"),
        F.when(u < held, "eval").otherwise("train").alias("split"),
    )


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys two tables share."""
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("shared"))


def marked_existing(candidates: DataFrame, cases: DataFrame, key: str = "transaction_id") -> DataFrame:
    """candidates with existing_case: whether a case for their key is there already."""
    known = cases.select(key).distinct().withColumn("existing_case", F.lit(True))
    return candidates.join(known, key, "left").fillna(False, ["existing_case"])


def engine_context(tables: dict[str, DataFrame], quarantine: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, as_of): what the engines run on. Quarantined rows are refused; as_of is one row, the latest transaction's time.

    quarantine: (table, reason, ...).
    """
    if bad := quarantine.groupBy("table").agg(F.count(F.lit(1)).alias("n")).orderBy("table").take(5):
        raise ValueError("quarantined rows in " + ", ".join(f"{r['table']} ({r['n']})" for r in bad))
    return tables, tables["transactions"].agg(F.max("timestamp").alias("as_of"))
