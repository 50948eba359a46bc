"""Reconciliation of orders with shipped lines, case assembly, and set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, guardrails, metrics, pipeline, reconcile
from ..session import table
from .common import LEDGER, TX, Slate, ledger, rounded, transactions

slate = Slate()
AS_OF = "timestamp_ntz'2001-08-01 00:00:00'"


def reconciled(spark, sf_dir):
    return reconcile.reconcile(transactions(spark, sf_dir), ledger(spark, sf_dir), F.expr(AS_OF))


M = f"""{TX}, {LEDGER}, p AS (SELECT *, row_number() OVER (PARTITION BY transaction_id
  ORDER BY posting_ts, ledger_id, posted_amount, currency, status, reference_id NULLS FIRST) AS rn,
  count(*) OVER (PARTITION BY transaction_id) AS n FROM led),
m AS (SELECT tx.transaction_id, tx.customer_id, tx.amount, tx.ts, tx.currency, tx.reference_id, p.ledger_id, p.posted_amount, p.currency AS p_currency, p.status,
  p.reference_id AS p_ref, p.posting_ts, coalesce(p.n, 0) AS n, CAST(round_even(tx.amount * 100, 0) AS BIGINT) AS c, CAST(round_even(p.posted_amount * 100, 0) AS BIGINT) AS pc,
  CAST(epoch_us(p.posting_ts) // 1000000 - epoch_us(tx.ts) // 1000000 AS BIGINT) AS lag,
  CAST(epoch_us(TIMESTAMP '2001-08-01 00:00:00') // 1000000 - epoch_us(tx.ts) // 1000000 AS BIGINT) AS age
  FROM tx LEFT JOIN p ON p.transaction_id = tx.transaction_id AND p.rn = 1)"""
RULES = [
    ("REC-001", "'high'", "ledger_id IS NULL", "NULL"), ("REC-002", "'high'", "n > 1", "n"),
    ("REC-003", "CASE WHEN abs(c - pc) * 1.0::double / greatest(abs(c), 1) >= 0.10::double THEN 'high' WHEN abs(c - pc) * 1.0::double / greatest(abs(c), 1) >= 0.01::double THEN 'medium' ELSE 'low' END",
     "abs(c - pc) > 1", "(c - pc) / 100.0::double"),
    ("REC-004", "'high'", "currency <> p_currency", "NULL"), ("REC-005", "'medium'", "ledger_id IS NOT NULL AND (reference_id IS NULL) <> (p_ref IS NULL)", "NULL"),
    ("REC-006", "'high'", "reference_id <> p_ref", "NULL"), ("REC-007", "'high'", "lag < 0", "lag"),
    ("REC-008", "CASE WHEN lag > 777600 THEN 'high' ELSE 'medium' END", "lag > 259200", "lag"), ("REC-009", "'medium'", "status = 'failed'", "NULL"),
    ("REC-010", "'medium'", "status = 'pending' AND age > 259200", "age"),
]
FINDINGS = f"WITH {M}, f AS (" + " UNION ALL ".join(
    f"SELECT transaction_id, customer_id, '{r}' AS rule_id, {s} AS severity, CAST({d} AS DOUBLE) AS difference FROM m WHERE {w}" for r, s, w, d in RULES) + ")"


@slate(FINDINGS + " SELECT rule_id, severity, count(*) AS n FROM f GROUP BY rule_id, severity")
def recon_summary(spark, sf_dir):
    """Findings by rule and severity."""
    return reconcile.findings(reconciled(spark, sf_dir)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@slate(FINDINGS + " SELECT transaction_id, customer_id, rule_id, severity, round(difference, 2) AS difference FROM f")
def recon_findings(spark, sf_dir):
    return reconcile.findings(reconciled(spark, sf_dir)).select("transaction_id", "customer_id", "rule_id", "severity", F.round("difference", 2).alias("difference"))


@slate(FINDINGS + " SELECT CASE WHEN k > 0 THEN 'discrepancy' ELSE 'reconciled' END AS status, count(*) AS n FROM (SELECT m.transaction_id, count(f.rule_id) AS k FROM m LEFT JOIN f USING (transaction_id) GROUP BY 1) GROUP BY 1")
def recon_status_counts(spark, sf_dir):
    return reconciled(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@slate(FINDINGS + " SELECT severity, count(*) AS n, count(DISTINCT transaction_id) AS transactions FROM f GROUP BY severity")
def recon_by_severity(spark, sf_dir):
    return reconcile.findings(reconciled(spark, sf_dir)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("transaction_id").alias("transactions"))


def _one_rule(rule):
    def query(spark, sf_dir):
        found = reconcile.findings(reconciled(spark, sf_dir)).filter(F.col("rule_id") == rule)
        return found.select("transaction_id", "severity", F.round("difference", 2).alias("difference"))

    return query


for _name, _rule in (("recon_missing_ledger", "REC-001"), ("recon_duplicate_posting", "REC-002"), ("recon_amount_mismatch", "REC-003"), ("recon_currency_mismatch", "REC-004"),
                     ("recon_reference_missing", "REC-005"), ("recon_reference_mismatch", "REC-006"), ("recon_posted_before", "REC-007"), ("recon_late_posting", "REC-008"),
                     ("recon_settlement_failed", "REC-009"), ("recon_stale_pending", "REC-010")):
    _q = _one_rule(_rule)
    _q.__name__ = _name
    slate(FINDINGS + f" SELECT transaction_id, severity, round(difference, 2) AS difference FROM f WHERE rule_id = '{_rule}'")(_q)


@slate(f"""{FINDINGS}, t AS (SELECT DISTINCT l_orderkey AS transaction_id FROM lineitem WHERE l_returnflag = 'R'), q AS (SELECT DISTINCT transaction_id FROM f WHERE rule_id = 'REC-009'),
c AS (SELECT count(*) FILTER (WHERE t.transaction_id IS NOT NULL AND q.transaction_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.transaction_id IS NULL) AS fp,
  count(*) FILTER (WHERE q.transaction_id IS NULL) AS fn FROM t FULL JOIN q ON t.transaction_id = q.transaction_id)
SELECT tp, fp, fn, round(tp::double / (tp + fp), 6) AS "precision", round(tp::double / (tp + fn), 6) AS recall, round(2.0::double * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def recon_truth_vs_pred(spark, sf_dir):
    """How well failures of the earliest posting tell of any returned line."""
    truth = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("transaction_id"))
    said = reconcile.findings(reconciled(spark, sf_dir)).filter("rule_id = 'REC-009'")
    return rounded(metrics.set_comparison(truth, said, ["transaction_id"]), "precision", "recall", "f1")


@slate(f"WITH {TX} SELECT customer_id, transaction_id, ts, amount FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, transaction_id DESC) AS rn FROM tx) WHERE rn = 1")
def tx_latest_per_customer(spark, sf_dir):
    return pipeline.latest(transactions(spark, sf_dir).select("customer_id", "transaction_id", "ts", "amount")).select("customer_id", "transaction_id", "ts", "amount")


CASES = f"""WITH {TX}, fo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, transaction_id DESC) AS rn FROM tx) WHERE rn = 1),
ctx AS (SELECT fo.transaction_id AS focus_id, tx.transaction_id, tx.amount, tx.ts FROM fo JOIN tx ON tx.customer_id = fo.customer_id AND tx.transaction_id <> fo.transaction_id
  AND tx.ts BETWEEN fo.ts - INTERVAL 365 DAY AND fo.ts)"""


@slate(CASES + " SELECT fo.customer_id, fo.transaction_id AS focus_id, count(ctx.transaction_id) AS n_context, round(coalesce(sum(ctx.amount), 0), 2) AS context_amount, coalesce(string_agg(CAST(ctx.transaction_id AS VARCHAR), ',' ORDER BY ctx.ts, ctx.transaction_id), '') AS context_ids FROM fo LEFT JOIN ctx ON ctx.focus_id = fo.transaction_id GROUP BY 1, 2")
def case_build(spark, sf_dir):
    """A case for each customer's latest transaction, with the year before it."""
    tx = transactions(spark, sf_dir)
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))
    papers = people.select("customer_id", F.col("name").alias("document_id"))
    built = pipeline.cases(people, papers, tx, pipeline.latest(tx), days=365)
    total = F.aggregate("context", F.lit(0.0), lambda a, x: a + x["amount"])
    ids = F.array_join(F.transform("context", lambda x: x["transaction_id"].cast("string")), ",")
    return built.select("customer_id", "focus_id", F.size("context").cast("long").alias("n_context"), F.round(total, 2).alias("context_amount"), ids.alias("context_ids"))


@slate(CASES + " SELECT focus_id, transaction_id FROM ctx")
def case_context_window(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    built = pipeline.cases(people, people.withColumn("document_id", F.col("customer_id")), tx, pipeline.latest(tx), days=365)
    return built.select("focus_id", F.explode("context.transaction_id").alias("transaction_id"))


@slate("SELECT 'orders' AS child, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0))")
def orphans(spark, sf_dir):
    """The cascade: rejecting every tenth customer orphans their orders, and these their lines."""
    people = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    tx = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lost = tx.join(people, "o_custkey", "left_anti")
    kept = tx.join(people, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").join(kept, "l_orderkey", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("child"), "n").unionByName(lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineitem").alias("child"), "n"))


@slate("SELECT 'orders without line' AS problem, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'repeated line key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def ref_integrity(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    parts = [
        ("orders without line", o.join(l, o.o_orderkey == l.l_orderkey, "left_anti")), ("line without order", l.join(o, o.o_orderkey == l.l_orderkey, "left_anti")),
        ("repeated line key", l.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")),
    ]
    out = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("problem"), "n") for p, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@slate(FINDINGS + " SELECT transaction_id, customer_id, coalesce(string_agg(rule_id, ',' ORDER BY rule_id), '') AS rules FROM (SELECT m.transaction_id, m.customer_id, f.rule_id FROM m LEFT JOIN f ON f.transaction_id = m.transaction_id) GROUP BY 1, 2")
def recon_results(spark, sf_dir):
    rules = F.array_join(F.transform("findings", lambda f: f["rule_id"]), ",")
    return reconciled(spark, sf_dir).select("transaction_id", "customer_id", rules.alias("rules"))


def _evidence(spark, sf_dir):
    rows = reconciled(spark, sf_dir).withColumn("case_id", F.col("customer_id"))
    return evidence.reconciliation_evidence(rows).unionByName(evidence.transaction_evidence(rows))


@slate(FINDINGS + ", e AS (SELECT customer_id AS case_id, 'REC-' || CAST(transaction_id AS VARCHAR) || '-' || rule_id AS evidence_id, 'reconciliation' AS source FROM f UNION ALL SELECT customer_id, 'REC-' || CAST(transaction_id AS VARCHAR) || '-OK', 'reconciliation' FROM m WHERE transaction_id NOT IN (SELECT transaction_id FROM f) UNION ALL SELECT customer_id, 'TXN-' || CAST(transaction_id AS VARCHAR), 'transaction' FROM m) SELECT * FROM e")
def evidence_union(spark, sf_dir):
    return _evidence(spark, sf_dir).select("case_id", "evidence_id", "source")


FLOOR = FINDINGS + ", r AS (SELECT customer_id AS case_id, count(*) FILTER (WHERE rule_id NOT IN ('REC-009', 'REC-010') AND severity IN ('medium', 'high')) AS n_reasons FROM f GROUP BY 1)"


@slate(FLOOR + " SELECT case_id, n_reasons, CASE WHEN n_reasons > 0 THEN 'REVIEW' END AS floor FROM r")
def engine_floor(spark, sf_dir):
    """The least decision that each customer's findings allow."""
    found = reconcile.findings(reconciled(spark, sf_dir)).withColumnRenamed("customer_id", "case_id")
    return guardrails.engine_floor(found.select("case_id", "rule_id", "severity")).select("case_id", F.size("reasons").cast("long").alias("n_reasons"), "floor")


def _model_cases(spark, sf_dir):
    floors = engine_floor(spark, sf_dir)
    c = F.col("case_id")
    return floors.select(
        "case_id", "floor", F.when(c % 5 == 0, None).when(c % 3 == 0, "ESCALATE").when(c % 2 == 0, "REVIEW").otherwise("CLEAR").alias("model_decision"),
        F.when(c % 4 == 0, 1).otherwise(0).alias("n_unsupported"), (c % 6).cast("int").alias("n_supported"), (c % 7 != 0).alias("grounded"),
        F.when(c % 8 == 0, 0.9).otherwise(0.5).alias("confidence"), F.lit(False).alias("suspicious"), F.lit("all fine").alias("text"),
    )


CRITIQUE = FLOOR + """, c AS (SELECT case_id, CASE WHEN n_reasons > 0 THEN 'REVIEW' END AS floor, CASE WHEN case_id % 5 = 0 THEN NULL WHEN case_id % 3 = 0 THEN 'ESCALATE' WHEN case_id % 2 = 0 THEN 'REVIEW' ELSE 'CLEAR' END AS model,
  CASE WHEN case_id % 4 = 0 THEN 1 ELSE 0 END AS u, case_id % 6 AS s, case_id % 7 <> 0 AS g, CASE WHEN case_id % 8 = 0 THEN 0.9 ELSE 0.5 END AS conf FROM r),
k AS (SELECT *, greatest(CASE model WHEN 'CLEAR' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'ESCALATE' THEN 3 ELSE 0 END, CASE WHEN floor IS NULL THEN 0 ELSE 2 END) AS a FROM c)"""


@slate(CRITIQUE + """ SELECT case_id, CASE greatest(a, CASE WHEN u > 0 THEN 2 ELSE 0 END) WHEN 1 THEN 'CLEAR' WHEN 2 THEN 'REVIEW' WHEN 3 THEN 'ESCALATE' END AS decision,
  concat_ws(',', CASE WHEN model = 'CLEAR' AND floor IS NOT NULL THEN 'CLEAR_BELOW_ENGINE_FLOOR' END, CASE WHEN model = 'CLEAR' AND u > 0 THEN 'CLEAR_WITH_UNSUPPORTED_CLAIMS' END,
   CASE WHEN model = 'CLEAR' AND s = 0 THEN 'CLEAR_WITHOUT_SUPPORTED_EVIDENCE' END, CASE WHEN NOT g THEN 'SUMMARY_NOT_GROUNDED' END,
   CASE WHEN u > 0 AND conf > 0.7 THEN 'HIGH_CONFIDENCE_WITH_UNSUPPORTED_CLAIMS' END) AS flags,
  model IS NOT NULL AND u = 0 AND g AND NOT (model = 'CLEAR' AND (floor IS NOT NULL OR u > 0 OR s = 0)) AS validated FROM k""")
def critique_decision(spark, sf_dir):
    return guardrails.critique(_model_cases(spark, sf_dir)).select("case_id", "decision", F.array_join("flags", ",").alias("flags"), "validated")


@slate(CRITIQUE + """, d AS (SELECT model AS m, CASE a WHEN 1 THEN 'CLEAR' WHEN 2 THEN 'REVIEW' WHEN 3 THEN 'ESCALATE' END AS fl, CASE greatest(a, CASE WHEN u > 0 THEN 2 ELSE 0 END) WHEN 1 THEN 'CLEAR' WHEN 2 THEN 'REVIEW' WHEN 3 THEN 'ESCALATE' END AS fu FROM k)
SELECT layer, decision, count(*) AS n FROM (SELECT 'model_only' AS layer, m AS decision FROM d UNION ALL SELECT 'with_floor', fl FROM d UNION ALL SELECT 'full', fu FROM d) GROUP BY 1, 2""")
def ablation_configs(spark, sf_dir):
    """Decisions by guardrail layer."""
    rows = guardrails.ablations(_model_cases(spark, sf_dir)).select("case_id", "model_only", "with_floor", "full")
    return rows.unpivot("case_id", ["model_only", "with_floor", "full"], "layer", "decision").groupBy("layer", "decision").agg(F.count(F.lit(1)).alias("n"))


@slate("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def inbox_page(spark, sf_dir):
    """A page of open orders, newest first (the page is the feature)."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return o.offset(20).limit(50).select("o_orderkey", "o_orderstatus", "o_totalprice")


@slate("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS amount, grouping(o_orderstatus) + grouping(o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"), (F.grouping("o_orderstatus") + F.grouping("o_orderpriority")).cast("long").alias("level"))
    return rows


@slate("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS other FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("other")
    rows = table(spark, sf_dir, "orders").withColumn("k", urgent)
    return rows.groupBy("o_orderstatus").pivot("k", ["urgent", "other"]).agg(F.count(F.lit(1))).fillna(0)


@slate("""SELECT c.c_custkey AS customer_id, n.n_name AS nation, r.r_name AS region, o.o_orderkey AS transaction_id, count(l.l_orderkey) AS n_postings FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3, 4""")
def timeline(spark, sf_dir):
    """Orders with their customer's nation and region and the number of postings; lines are counted before the join."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    posted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_postings"))
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(posted, "o_orderkey", "left").fillna(0, ["n_postings"])
    rows = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("o_custkey").alias("customer_id"), "nation", "region", F.col("o_orderkey").alias("transaction_id"), "n_postings")
