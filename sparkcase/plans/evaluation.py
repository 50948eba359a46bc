"""Detection and ranking metrics, anomaly models, and report assembly over events, labels and orders."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions.scalar import wilson
from ..operators import evidence, history as H, metrics, models, structured
from ..session import table
from .common import Slate, history, rounded

slate = Slate()


def _scored(spark, sf_dir):
    """Labelled documents with a coarse score, so that ties matter."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    l = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(l, "doc_id").select(F.col("doc_id").alias("id"), "label", "lang", (F.least(F.floor(F.col("n_chars") / 100), F.lit(40)) / 40.0).alias("score"))


SC = "s AS (SELECT d.doc_id AS id, l.quality AS label, d.lang, least(n_chars // 100, 40) / 40.0::double AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"
PT = f"""WITH {SC}, a AS (SELECT score, sum(label) AS p, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen, sum(p) OVER () AS pos, sum(n) OVER () AS total FROM a)"""


@slate(PT + " SELECT round(sum(p::double / pos * tp / seen), 6) AS average_precision, round(sum(p::double * ((total - pos) - (seen - tp) + (n - p) / 2.0::double) / (pos::double * (total - pos))), 6) AS roc_auc FROM b")
def ap_auc(spark, sf_dir):
    points = metrics.curve(_scored(spark, sf_dir))
    both = metrics.average_precision(points).join(metrics.roc_auc(points))
    return rounded(both, "average_precision", "roc_auc")


@slate(PT + ", f AS (SELECT score, CASE WHEN tp > 0 THEN 2.0::double * tp / (seen + pos) ELSE 0 END AS f1 FROM b) SELECT round(score, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, score LIMIT 1")
def threshold_f1(spark, sf_dir):
    return rounded(metrics.f1_threshold(metrics.curve(_scored(spark, sf_dir))), "threshold", "f1")


@slate(f"""WITH {SC}, c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn FROM s)
SELECT round(tp::double / (tp + fp), 6) AS "precision", round(tp::double / (tp + fn), 6) AS recall, round(2.0::double * tp / (2 * tp + fp + fn), 6) AS f1, round(fp::double / (fp + tn), 6) AS fpr, round(fn::double / (fn + tp), 6) AS fnr, round((tp + fp)::double / (tp + fp + fn + tn), 6) AS share FROM c""")
def operating_point(spark, sf_dir):
    return rounded(metrics.operating_point(_scored(spark, sf_dir), F.lit(0.5)), "precision", "recall", "f1", "fpr", "fnr", "share")


@slate(f"""WITH {SC}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn, count(*) OVER () AS n, sum(label) OVER () AS pos FROM s), b AS (SELECT unnest([0.01::double, 0.02::double, 0.1::double]) AS budget)
SELECT budget, CAST(greatest(1, round_even(budget * n, 0)) AS BIGINT) AS size, round(sum(label)::double / greatest(1, round_even(budget * n, 0)), 6) AS "precision", round(sum(label)::double / max(pos), 6) AS recall FROM r, b WHERE rn <= greatest(1, round_even(budget * n, 0)) GROUP BY budget, n""")
def budget_precision(spark, sf_dir):
    return rounded(metrics.at_budget(_scored(spark, sf_dir), (0.01, 0.02, 0.1)), "precision", "recall")


@slate(f"WITH {SC} SELECT lang, round(avg(CASE WHEN score >= 0.5 THEN 1.0::double ELSE 0 END), 6) AS recall, count(*) AS n FROM s WHERE label = 1 GROUP BY lang")
def recall_by_type(spark, sf_dir):
    rows = _scored(spark, sf_dir).filter("label = 1").withColumn("flag", F.col("score") >= 0.5)
    return rounded(metrics.recall_by(rows, "lang", "flag"), "recall")


def _pairs(spark, sf_dir):
    """Neighbours in embeddings as candidates: gold where the labels agree."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("mine"))
    near = q.withColumn("vec_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.col("query_id") + i))).join(e, "vec_id")
    return near.select("query_id", "vec_id", (F.col("mine") == F.col("label")).alias("gold"), ((F.col("vec_id") * 7919 % 100) / 100.0).alias("score"))


PR = """n AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS gold, (b.vec_id * 7919 % 100) / 100.0::double AS score FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 8 WHERE a.vec_id % 25 = 0)"""


@slate(f"""WITH {PR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM n), q AS (SELECT query_id, min(rank) FILTER (WHERE gold) AS f, sum(CASE WHEN gold AND rank <= 5 THEN 1 / log2(rank + 1.0::double) ELSE 0 END) AS dcg, count(*) FILTER (WHERE gold) AS g FROM r GROUP BY 1),
i AS (SELECT q.query_id, sum(1 / log2(k + 1.0::double)) AS ideal FROM q, (SELECT unnest(range(1, 6)) AS k) WHERE k <= least(g, 5) GROUP BY 1)
SELECT round(avg(coalesce(1.0::double / f, 0)), 6) AS mrr, round(avg(CASE WHEN f = 1 THEN 1.0::double ELSE 0 END), 6) AS top1, round(avg(CASE WHEN f <= 5 THEN 1.0::double ELSE 0 END), 6) AS hit, round(avg(CASE WHEN g > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg FROM q LEFT JOIN i ON i.query_id = q.query_id""")
def ranking_metrics(spark, sf_dir):
    from pyspark.sql import Window

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = _pairs(spark, sf_dir).withColumn("rank", F.row_number().over(best))
    return rounded(metrics.ranking(rows), "mrr", "top1", "hit", "ndcg")


@slate(f"""WITH {PR}, q AS (SELECT query_id, count(*) FILTER (WHERE score >= 0.5 AND gold) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT gold) AS fp, count(*) FILTER (WHERE score < 0.5 AND gold) AS fn FROM n GROUP BY 1), t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(CASE WHEN fp > 0 THEN 1.0::double ELSE 0 END) AS fm FROM q)
SELECT round(tp::double / (tp + fp), 6) AS "precision", round(tp::double / (tp + fn), 6) AS recall, round(2.0::double * tp / (2 * tp + fp + fn), 6) AS f1, round(fm, 6) AS false_match FROM t""")
def matching_metrics(spark, sf_dir):
    return rounded(metrics.matching(_pairs(spark, sf_dir), 0.5), "precision", "recall", "f1", "false_match")


@slate("SELECT lang, n, hits, round(greatest(0, (p + 3.8416::double / (2 * n) - 1.96::double * sqrt((p * (1 - p) + 3.8416::double / (4 * n)) / n)) / (1 + 3.8416::double / n)), 6) AS low, round(least(1, (p + 3.8416::double / (2 * n) + 1.96::double * sqrt((p * (1 - p) + 3.8416::double / (4 * n)) / n)) / (1 + 3.8416::double / n)), 6) AS high FROM (SELECT d.lang, count(*) AS n, CAST(sum(l.toxic) AS BIGINT) AS hits, sum(l.toxic)::double / count(*) AS p FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)")
def wilson_ci(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = d.join(l, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return rounded(rows.withColumns({"low": low, "high": high}), "low", "high")


@slate()
def bootstrap_ci(spark, sf_dir):
    """Interval of the mean event value by customer clusters; statistical parity only."""
    return metrics.bootstrap(history(spark, sf_dir), "customer", F.col("amount"))


def _features(spark, sf_dir):
    rows = H.with_novelty(H.with_rhythm(H.with_amounts(H.with_counts(history(spark, sf_dir)))))
    return rows.withColumn("label", (F.col("country") == "error").cast("int"))


@slate()
def anomaly_logistic(spark, sf_dir):
    """A logistic model of the history features fitted on the first 60 % of time; scores, drivers and the split of every event."""
    # The class shares, the scaler, the fit and the scores all read the features: they are computed once.
    rows = H.chronological_split(_features(spark, sf_dir)).persist(StorageLevel.DISK_ONLY)
    model = models.fit("logistic", rows.filter("split = 'train'"))
    out = models.drivers(model, models.scored(model, rows))
    return out.select("transaction_id", "split", "score", F.element_at("drivers", 1)["feature"].alias("first_driver"))


@slate()
def anomaly_isolation_forest(spark, sf_dir):
    return models.isolation_forest(_features(spark, sf_dir)).select("transaction_id", "score")


@slate()
def anomaly_reconstruction(spark, sf_dir):
    return models.reconstruction_error(_features(spark, sf_dir)).select("transaction_id", "score")


@slate("SELECT user_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type_code FROM (SELECT DISTINCT user_id, event_type FROM events)")
def category_codes(spark, sf_dir):
    rows = models.codes(table(spark, sf_dir, "events").select("user_id", "event_type").distinct(), "event_type")
    return rows.select("user_id", "event_type", F.col("event_type_code").cast("long").alias("event_type_code"))


@slate("SELECT user_id AS case_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events WHERE event_type = 'error' GROUP BY 1")
def case_report(spark, sf_dir):
    """Error events as a case's evidence, in one row."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("case_id"), F.format_string("%012d", "event_id").alias("evidence_id"), F.lit("anomaly").alias("source"), F.lit("error").alias("description"))
    rows = evidence.report(e, e.select("case_id").distinct())
    ids = F.array_join(F.transform("items", lambda x: x["evidence_id"].cast("long").cast("string")), ",")
    return rows.select("case_id", F.col("n_items").alias("n"), ids.alias("ids"))


@slate("SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def payload_leaves(spark, sf_dir):
    """The leaves of each event's JSON payload."""
    e = table(spark, sf_dir, "events").withColumn("x", structured.leaves(F.col("props")))
    return e.select("event_id", F.get(F.filter("x", lambda x: x["path"] == "k"), F.lit(0))["value"].alias("k"), (F.size("x") > 0).alias("valid"))


@slate("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'no complete JSON object' WHEN conv_id % 3 = 0 THEN 'action: not allowed' ELSE '' END AS errors FROM conversations WHERE NOT regexp_matches(text, '[{}]')")
def structured_parse(spark, sf_dir):
    """The JSON answer in a turn's text and what is wrong with it; even turns are cut off."""
    t = table(spark, sf_dir, "conversations").filter(~F.col("text").rlike("[{}]"))
    action = F.when(F.col("conv_id") % 3 == 0, "FLY").otherwise("REVIEW")
    answer = F.concat(F.col("text"), F.lit(' {"action": "'), action, F.lit('", "confidence": 0.5'), F.when(F.col("turn") % 2 == 0, "").otherwise("} done"))
    rows = structured.parsed(t.select("conv_id", "turn", answer.alias("answer")), structured.extracted(F.col("answer")), {"action": "string", "confidence": "double"}, {"action": ("CLEAR", "REVIEW", "ESCALATE")})
    return rows.select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))


@slate("""WITH f AS (SELECT d.lang, l.toxic = 1 AS attack, d.n_chars > 2000 AS long_text, l.quality = 0 AS poor FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
u AS (SELECT lang, attack, 'long_text' AS detector, long_text AS hit FROM f UNION ALL SELECT lang, attack, 'poor', poor FROM f)
SELECT lang, detector, count(*) FILTER (WHERE attack) AS attacks, count(*) FILTER (WHERE attack AND hit) AS found, count(*) FILTER (WHERE NOT attack AND hit) AS false_positives, round(CASE WHEN count(*) FILTER (WHERE attack) > 0 THEN count(*) FILTER (WHERE attack AND hit)::double / count(*) FILTER (WHERE attack) ELSE 0 END, 6) AS recall FROM u GROUP BY 1, 2""")
def detector_evaluation(spark, sf_dir):
    """Two plain detectors of toxic documents, by language."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels")
    rows = d.join(l, "doc_id").select("lang", (F.col("toxic") == 1).alias("attack"), (F.col("n_chars") > 2000).alias("long_text"), (F.col("quality") == 0).alias("poor"))
    return rounded(structured.detectors(rows, ["long_text", "poor"], ("lang",)), "recall")


@slate()
def embedding_tripwire(spark, sf_dir):
    """A logistic score of every embedding for the label 0."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), (F.col("label") == 0).cast("int").alias("label"))
    return structured.tripwire(structured.fit_tripwire(e), e).select("vec_id", "label", "trip_score")


@slate()
def structured_parse_all(spark, sf_dir):
    """The first complete JSON object in every turn's own text, with what is wrong with it as an answer."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"))
    rows = structured.parsed(t.withColumn("object", structured.extracted(F.col("answer"))), F.col("object"), {"action": "string", "confidence": "double"}, {"action": ("CLEAR", "REVIEW", "ESCALATE")})
    return rows.select("conv_id", "turn", "object", F.array_join("errors", ",").alias("errors"))
