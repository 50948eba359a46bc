"""Views as of a time, and how good lists of candidates and scores are, with intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstraps, retrieval
from ..operators import timeline as timelines
from ..session import table
from .common import Slate, history, rounded
from .evaluation import _pairs
from .texts import DENSE, _vectors

slate = Slate()


@slate("""WITH d AS (SELECT o_custkey AS customer_id, o_orderdate AS ts, max(o_orderstatus) AS decision FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2),
f AS (SELECT l_orderkey, count(*) AS n, string_agg(DISTINCT l_linestatus || ':' || l_returnflag, ',' ORDER BY l_linestatus || ':' || l_returnflag) AS details FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o.o_orderkey AS transaction_id, coalesce(f.n, 0) AS n_findings, coalesce(f.details, '') AS details, CASE WHEN o.o_orderkey % 3 = 0 THEN round(o.o_totalprice / 1000000, 6) END AS score, d.decision, CAST(d.ts AS DATE) AS decided_on
FROM orders o ASOF LEFT JOIN d ON d.customer_id = o.o_custkey AND d.ts <= o.o_orderdate LEFT JOIN f ON f.l_orderkey = o.o_orderkey""")
def customer_timeline(spark, sf_dir):
    """Every order with its findings and score, and the customer's latest urgent order's status by its date."""
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    tx = o.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("transaction_id"))
    found = lines.select(F.col("l_orderkey").alias("transaction_id"), F.col("l_linestatus").alias("rule_id"), F.col("l_returnflag").alias("severity"))
    scores = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("transaction_id"), (F.col("o_totalprice") / 1_000_000).alias("score"))
    decisions = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("decision"))
    rows = timelines.customer_view(tx, found, scores, decisions)
    details = F.array_join(F.transform(F.coalesce("details", F.array().cast("array<struct<rule_id:string,severity:string>>")), lambda x: F.concat_ws(":", x["rule_id"], x["severity"])), ",")
    return rounded(rows.select("transaction_id", "n_findings", details.alias("details"), "score", "decision", F.col("decided_at").cast("date").alias("decided_on")), "score")


@slate(f"""WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM pr), l AS (SELECT * FROM r WHERE rank <= 20),
g AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 10 = 1 AND a.vec_id % 25 = 0),
m AS (SELECT g.query_id, count(*) AS n, count(l.doc_id) AS found FROM g LEFT JOIN l ON l.query_id = g.query_id AND l.doc_id = g.doc_id GROUP BY 1),
t AS (SELECT round(s, 9) AS s, query_id % 2 = 0 AS y FROM l WHERE rank = 1)
SELECT (SELECT round(avg(CASE WHEN found > 0 THEN 1.0::double ELSE 0 END), 6) FROM m) AS candidate_recall_any, (SELECT round(sum(found)::double / sum(n), 6) FROM m) AS candidate_recall_pairs,
(SELECT round(avg(CASE WHEN p.s > q.s THEN 1.0::double WHEN p.s = q.s THEN 0.5 ELSE 0 END), 6) FROM t p, t q WHERE p.y AND NOT q.y) AS separation""")
def candidate_quality(spark, sf_dir):
    """How many neighbours of a query's own label are among its 20 nearest, and how well the first score tells two kinds of queries."""
    q, d = _vectors(spark, sf_dir)
    near = retrieval.nearest(q, d, 20).withColumn("score", F.round("dense", 9))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    gold = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.filter("vec_id % 10 = 1").select(F.col("vec_id").alias("doc_id"), "label"), "label")
    found = bootstraps.candidate_recall(near, gold)
    return rounded(found.join(bootstraps.separation(near, F.col("query_id") % 2 == 0)), "candidate_recall_any", "candidate_recall_pairs", "separation")  # one row each


@slate()
def curve_intervals(spark, sf_dir):
    """PR-AUC, ROC-AUC and F1 of events' values as scores of errors, with intervals over customers."""
    rows = history(spark, sf_dir).select("customer", F.col("amount").alias("score"), (F.col("country") == "error").alias("label"))
    return rounded(bootstraps.curves(rows, 10.0, cluster="customer"), "estimate", "low", "high")


@slate()
def matching_intervals(spark, sf_dir):
    """Pair precision, recall, F1 and rates at 0.5, with intervals over queries."""
    return rounded(bootstraps.matching(_pairs(spark, sf_dir), 0.5), "estimate", "low", "high")
