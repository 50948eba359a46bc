"""Studies over cases: namesakes, composition, exposure, paired systems, ablations, pools and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import evidence, guardrails, history, metrics, resolution, retrieval
from ..session import table
from .common import Slate, rounded, transactions
from .evaluation import PR, _pairs

slate = Slate()

PEOPLE = """p AS (SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation FROM customer
  UNION ALL SELECT s_suppkey + 100000000, replace(s_name, 'Supplier', 'Customer'), s_nationkey FROM supplier)"""


@slate(f"WITH {PEOPLE} SELECT a.customer_id, b.customer_id AS other_id FROM p a JOIN p b ON a.name = b.name AND a.customer_id <> b.customer_id WHERE a.nation <> b.nation")
def namesake_pairs(spark, sf_dir):
    """Customers and suppliers of one name, both ways, who are not in one nation."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    people = c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).unionByName(
        s.select((F.col("s_suppkey") + 100_000_000).alias("customer_id"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"), F.col("s_nationkey").alias("nation")))
    same = people.join(people.select("name", "nation", F.col("customer_id").alias("same_id")), ["name", "nation"]).filter("customer_id < same_id")
    return resolution.namesakes(people, same.select("customer_id", "same_id"))


@slate("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def composition_cube(spark, sf_dir):
    return metrics.composition(table(spark, sf_dir, "documents"), "lang", "source")


@slate(f"""WITH {PR}, s AS (SELECT *, unnest([CASE WHEN vec_id - query_id <= 4 THEN 'near' ELSE 'far' END, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS slice FROM n),
c AS (SELECT slice, count(*) FILTER (WHERE score >= 0.5 AND gold) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT gold) AS fp, count(*) FILTER (WHERE score < 0.5 AND gold) AS fn FROM s GROUP BY 1)
SELECT slice, round(CASE WHEN tp + fp > 0 THEN tp::double / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp::double / (tp + fn) END, 6) AS recall FROM c""")
def matching_slices(spark, sf_dir):
    near, even = F.col("vec_id") - F.col("query_id") <= 4, F.col("vec_id") % 2 == 0
    rows = _pairs(spark, sf_dir).withColumn("slice", F.array(F.when(near, "near").otherwise("far"), F.when(even, "even").otherwise("odd")))
    return rounded(metrics.matching_by_slice(rows, 0.5), "precision", "recall")


@slate(f"""WITH {PR}, r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, CASE WHEN vec_id % 11 = 0 THEN 'poison' WHEN gold THEN 'gold' ELSE 'other' END AS kind FROM n),
q AS (SELECT query_id, min(rank) FILTER (WHERE kind = 'poison') AS p, min(rank) FILTER (WHERE kind = 'gold') AS g FROM r GROUP BY 1)
SELECT count(*) AS queries, count(*) FILTER (WHERE p <= 5) AS exposed, count(*) FILTER (WHERE p <= 5 AND (g IS NULL OR p < g)) AS above_gold FROM q WHERE p IS NOT NULL""")
def poison_exposure(spark, sf_dir):
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kind = F.when(F.col("vec_id") % 11 == 0, "poison").when(F.col("gold"), "gold").otherwise("other")
    return metrics.poisoning_exposure(_pairs(spark, sf_dir).select("query_id", F.row_number().over(best).alias("rank"), kind.alias("kind")))


@slate("""WITH c AS (SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS a, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS b FROM orders GROUP BY 1)
SELECT count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a < b) AS losses, count(*) FILTER (WHERE a = b) AS ties FROM c WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_systems(spark, sf_dir):
    """Customers whose dearest open order is above, below or like their dearest filled one."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("system"), F.col("o_totalprice").alias("score"))
    return metrics.paired_wins(rows, "O", "F")


@slate("""WITH s AS (SELECT l_orderkey AS case_id, l_partkey % 9 AS doc_id, min(l_linenumber * 1000 + CAST(l_quantity AS BIGINT)) AS seen FROM lineitem GROUP BY 1, 2),
r AS (SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY seen, doc_id) AS place FROM s) SELECT * FROM r WHERE place <= 4""")
def first_seen_passages(spark, sf_dir):
    """Order lines as queries that bring up parts' classes: the first four different ones of each order."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 9).alias("doc_id"), F.col("l_linenumber").alias("query_index"), F.col("l_quantity").cast("long").alias("rank"))
    return retrieval.first_seen(rows)


@slate("""WITH e AS (SELECT epoch_us(ts) // 1000000 AS t, ['train', 'validation', 'test'][event_id % 3 + 1] AS split FROM events), s AS (SELECT split, min(t) AS first, max(t) AS latest FROM e GROUP BY 1),
o AS (SELECT *, list_position(['train', 'validation', 'test'], split) AS i FROM s) SELECT a.split AS earlier, b.split AS later, a.latest, b.first FROM o a JOIN o b ON a.i < b.i WHERE a.latest >= b.first""")
def split_leaks(spark, sf_dir):
    """What a split by id instead of time leaks: every split reaches into every later one."""
    name = F.get(F.array(*map(F.lit, ("train", "validation", "test"))), (F.col("event_id") % 3).cast("int"))
    return history.leaks(table(spark, sf_dir, "events").select(scalar.epoch_seconds(F.col("ts")).alias("t"), name.alias("split")))


_SEVERITY = "CASE WHEN l_tax >= 0.06 THEN 3 WHEN l_tax >= 0.03 THEN 2 ELSE 1 END"
_LEAST = {"low": 1, "medium": 2, "high": 3}
_BY_KIND = {
    "recon": "l_linenumber % 3 = 0 AND sev >= {least} AND (l_suppkey % 5 <> 0 OR {status})", "anomaly": "l_linenumber % 3 = 1 AND l_discount > 0.08",
    "kyc": "l_linenumber % 3 = 2 AND l_quantity > 45",
}
ABLATION = ", ".join(
    "coalesce(max(CASE WHEN " + " OR ".join(f"({_BY_KIND[e].format(least=_LEAST[least], status=str(status).lower())})" for e in engines) + f" THEN 1 ELSE 0 END), 0) AS \"{name}\""
    for name, engines, least, status in guardrails.CONFIGURATIONS
)
_NAMES = ", ".join(f'"{name}"' for name, *_ in guardrails.CONFIGURATIONS)


@slate(f"""WITH e AS (SELECT *, {_SEVERITY} AS sev FROM lineitem), c AS (SELECT l_orderkey, {ABLATION} FROM e GROUP BY 1)
SELECT configuration, sum(flagged)::BIGINT AS flagged, count(*) AS cases FROM (UNPIVOT c ON {_NAMES} INTO NAME configuration VALUE flagged) GROUP BY 1""")
def component_ablation(spark, sf_dir):
    """Order lines as evidence of three engines: how many orders each of the ten configurations flags."""
    line, key = F.col("l_linenumber") % 3, F.col("l_linenumber").cast("string")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.when(line == 0, "REC-").when(line == 1, "ANOM-").otherwise("KYCM-"), key).alias("evidence_id"),
        F.when(line == 0, F.when(F.col("l_suppkey") % 5 == 0, "REC-009").otherwise("REC-003")).alias("rule_id"),
        F.when(line == 0, F.when(F.col("l_tax") >= 0.06, "high").when(F.col("l_tax") >= 0.03, "medium").otherwise("low")).alias("severity"),
        F.when(line == 1, F.col("l_discount") > 0.08).alias("flagged"), F.when(line == 2, (F.col("l_quantity") > 45).cast("int")).alias("other_strong"))
    flags = guardrails.component_ablation(rows)
    return flags.groupBy("configuration").agg(F.count_if("flagged").alias("flagged"), F.count(F.lit(1)).alias("cases"))


@slate("SELECT o_orderkey AS transaction_id, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS existing_case FROM orders")
def existing_cases(spark, sf_dir):
    """Orders of customers who have a pending one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transaction_id"), "o_custkey", "o_orderstatus")
    return evidence.marked_existing(o, o.filter("o_orderstatus = 'P'"), "o_custkey").select("transaction_id", "existing_case")


@slate("""WITH r AS (SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderpriority AS p, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM orders)
SELECT transaction_id, customer_id, CASE WHEN p = '1-URGENT' THEN 'urgent' ELSE 'clean' END AS category FROM r WHERE n > 10""")
def case_pool(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("transaction_id"), F.lit("urgent").alias("category"))
    return evidence.case_pool(tx, urgent).select("transaction_id", "customer_id", "category")


@slate("SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def shared_customers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return evidence.overlap(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


@slate("""SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS stamp,
  CASE WHEN length(props) > 8 THEN left(props, 8) || '…' ELSE props END AS payload, CASE WHEN regexp_matches(event_type, '^[A-Za-z0-9][A-Za-z0-9_.:-]{0,63}$') THEN event_type END AS safe FROM events""")
def prompt_fields(spark, sf_dir):
    """Fields as they stand in a prompt: ISO times, shortened payloads, safe ids."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", scalar.iso_time(F.col("ts")).alias("stamp"), scalar.payload(F.col("props"), 8).alias("payload"), scalar.safe_id(F.col("event_type")).alias("safe"))
