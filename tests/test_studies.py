"""Operators of studies over cases, on small frames worked out by hand."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sparkcase import sources
from sparkcase.functions import scalar
from sparkcase.operators import evidence, generate, guardrails, history, knowledge, metrics, models, reconcile, resolution, retrieval


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pair_features_have_the_names_structure(spark):
    pairs = spark.createDataFrame([
        (1, 7, "Haddad, Omar K.", "Omar Khalid Haddad"), (1, 7, "Haddad, Omar K.", "O. Hadad"), (2, 8, "Ava Brown", "Ava Lee Brown"), (3, 9, "Ava B Brown", "Ava C Brown")],
        "query_id int, customer_id int, q_name string, name string")
    signals = spark.createDataFrame([(1, 7, 4, 0.5, 0.25, 0.75, 0.5, 0.5)], "query_id int, customer_id int, rank int, bm25 double, bm25_char double, dense double, fuzzy double, hybrid double")
    got = {r["query_id"]: r for r in resolution.pair_features(pairs, signals).collect()}
    assert len(resolution.FEATURES) == 17 and all(got[1][f] is not None for f in resolution.FEATURES)
    one = got[1]
    assert one["alias"] == "Omar Khalid Haddad" and one["inverse_rank"] == 0.25 and one["dense"] == 0.75
    assert (one["first_exact"], one["last_exact"], one["middle_compatible"], one["query_has_initials"], one["query_reordered"]) == (1, 1, 1, 1, 1)
    assert got[2]["middle_compatible"] == 1 and got[2]["token_gap"] == 1 and got[2]["hybrid"] == 0
    assert got[3]["middle_compatible"] == 0 and got[3]["jw_first"] == 1


def test_the_full_system_puts_the_right_customer_first(spark):
    names = ["omar haddad", "ava brown", "kenji tanaka", "lucia rossi", "noah adams", "sofia petrov", "ivan larsen", "mei zhang"]
    address = "struct(true as parsed, '1' as number, 'hill' as street, 'leeds' as city, 'GB' as country)"
    entries = spark.createDataFrame([(i, n, dt.date(1980, 1, i + 1)) for i, n in enumerate(names)], "customer_id int, name string, birth date").withColumn("address", F.expr(address))
    queries = spark.createDataFrame([(i, n[:-1] + n[-1] * 2, dt.date(1980, 1, i + 1)) for i, n in enumerate(names)], "query_id int, name string, birth date").withColumn("address", F.expr(address))
    near = queries.select("query_id").crossJoin(entries.select("customer_id")).withColumn("score", (F.col("query_id") == F.col("customer_id")).cast("double") * 0.5)
    stage = resolution.first_stage(queries, entries, near).cache()
    pairs = stage.select("query_id", "customer_id").join(queries.select("query_id", F.col("name").alias("q_name")), "query_id").join(entries.select("customer_id", "name"), "customer_id")
    labelled = resolution.pair_features(pairs, stage).withColumn("label", (F.col("query_id") == F.col("customer_id")).cast("int"))
    model = resolution.fit_reranker(labelled, trees=3)
    best = resolution.full_system(model, queries, entries, entries, stage).filter("rank = 1")
    assert rows(best.select("query_id", "customer_id")) == [(i, i) for i in range(8)]


def test_namesakes_come_both_ways_without_gold(spark):
    people = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b"), (4, "c d")], "customer_id int, name string")
    gold = spark.createDataFrame([(1, 2)], "customer_id int, same_id int")
    assert rows(resolution.namesakes(people, gold)) == [(1, 3), (2, 3), (3, 1), (3, 2)]


def test_ablation_counts_only_an_engines_evidence(spark):
    items = [(1, "REC-1", "REC-003", "high", None, None), (2, "REC-1", "REC-003", "low", None, None), (3, "REC-1", "REC-009", "medium", None, None),
             (4, "ANOM-1", None, None, True, None), (5, "KYCM-1", None, None, None, 2), (6, "TXN-1", None, None, None, None)]
    e = spark.createDataFrame(items, "case_id int, evidence_id string, rule_id string, severity string, flagged boolean, other_strong int")
    flags = guardrails.component_ablation(e).filter("flagged").groupBy("configuration").agg(F.sort_array(F.collect_list("case_id")).alias("c"))
    got = {r["configuration"]: r["c"] for r in flags.collect()}
    assert got == {
        "full": [1, 4, 5], "recon": [1], "anomaly": [4], "kyc": [5], "recon_anomaly": [1, 4], "recon_kyc": [1, 5], "anomaly_kyc": [4, 5],
        "low_severity": [1, 2, 4, 5], "high_severity": [1, 4, 5], "status_rules": [1, 3, 4, 5]}
    assert guardrails.of_engines(e, ("kyc",)).count() == 2
    truth = spark.createDataFrame([(1, "reconciliation"), (2, "reconciliation"), (4, "behavioural"), (5, "clean"), (6, "clean")], "case_id int, category string")
    rate = {r["configuration"]: r for r in guardrails.ablation_rates(guardrails.component_ablation(e), truth).collect()}["full"]
    assert (rate["recall_reconciliation"], rate["recall_behavioural"], rate["false_flags"]) == (0.5, 1.0, 0.5) and rate["precision"] == pytest.approx(2 / 3)


def test_claims_that_cite_wrongly_are_caught_and_pointed_elsewhere(spark):
    items = spark.createDataFrame([(1, "TXN-1", "evidence", "transfer of 250.00 USD"), (1, "KYC-1", "evidence", "account is 31 days old")], "case_id int, ref string, kind string, text string")
    claims = spark.createDataFrame([(1, 0, "The transfer was 250.00 USD", "fact", ["TXN-1"])], "case_id int, claim_id int, claim string, claim_kind string, refs array<string>")
    forms = guardrails.perturbed_citations(claims, items)
    assert rows(forms.select("change")) == [("no_citation",), ("unknown_evidence",), ("wrong_citation",)]
    for change, refs in [("wrong_citation", ["KYC-1"]), ("no_citation", [])]:
        judged = guardrails.verdicts(forms.filter(F.col("change") == change).drop("change"), items)
        assert [tuple(r) for r in judged.select("refs", "status").collect()] == [(refs, "unsupported")]
        assert rows(guardrails.elsewhere(judged, items)) == [(1, 0, ["TXN-1"])]
        assert rows(guardrails.verdict_counts(judged, "case_id")) == [(1, 0, 1, 0)]


def test_study_metrics(spark):
    cube = metrics.composition(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "x string, y int"), "x", "y")
    assert cube.filter("x is null and y is null").first()["n"] == 3 and cube.count() == 3 + 2 + 2 + 1
    ranks = spark.createDataFrame([(1, 1, "poison"), (1, 2, "gold"), (2, 1, "gold"), (2, 3, "poison"), (3, 9, "poison"), (4, 1, "gold")], "query_id int, rank int, kind string")
    assert rows(metrics.poisoning_exposure(ranks)) == [(3, 2, 1)]
    scores = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (2, "b", 1.0), (3, "a", 5.0)], "case_id int, system string, score double")
    assert rows(metrics.paired_wins(scores, "a", "b")) == [(1, 0, 1)]


def test_leaks_between_splits(spark):
    split = spark.createDataFrame([("train", 1), ("train", 5), ("validation", 5), ("test", 7)], "split string, t int")
    assert rows(history.leaks(split)) == [("train", "validation", 5, 5)]
    with pytest.raises(ValueError):
        history.assert_no_leak(split)
    history.assert_no_leak(split.filter("split <> 'validation'"))


def test_first_seen_passages(spark):
    found = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 0, 1), (1, 3, 1, 1), (1, 2, 1, 1), (1, 4, 2, 1), (1, 5, 2, 2)], "case_id int, doc_id int, query_index int, rank int")
    assert rows(retrieval.first_seen(found)) == [(1, 1, 2), (1, 2, 1), (1, 3, 3), (1, 4, 4)]


def test_cases_for_training(spark):
    day = lambda d: dt.datetime(2025, 1, 1) + dt.timedelta(days=d)
    tx = spark.createDataFrame([(f"T{c}{d:02}", c, day(d)) for c in "abc" for d in range(13)], "transaction_id string, customer_id string, ts timestamp_ntz")
    problems = spark.createDataFrame([("Ta11", "recon"), ("Tb12", "recon")], "transaction_id string, category string")
    pool = evidence.case_pool(tx, problems)
    assert rows(pool.select("transaction_id", "category")) == [(f"T{c}{d}", "recon" if f"{c}{d}" in ("a11", "b12") else "clean") for c in "abc" for d in (11, 12)]
    assert evidence.case_pool(tx, problems, "2025-01-13").count() == 3
    picked = evidence.one_a_customer(pool, spark.createDataFrame([("c",)], "customer_id string"), 5, 3)
    assert rows(picked.select("customer_id")) == [("a",), ("b",)]
    statements = picked.select(F.col("transaction_id").alias("case_id"), F.array(F.lit("s")).alias("statements"))
    passages = statements.select("case_id", F.array(F.lit("p")).alias("passages")).limit(1)
    data = evidence.training_set(picked.withColumnRenamed("transaction_id", "case_id"), statements, passages, 1, held=0.5)
    assert data.count() == 2 and all(r["target"] == '{"findings":["s"]}' and r["split"] in ("train", "eval") for r in data.collect())
    assert evidence.overlap(data.filter("split = 'train'"), data.filter("split = 'eval'"), "customer_id").first()[0] == 0
    assert rows(evidence.marked_existing(tx.select("transaction_id").limit(1), tx)) == [("Ta00", True)]


def test_engines_refuse_quarantined_tables(spark):
    tx = spark.createDataFrame([(dt.datetime(2025, 1, 2),), (dt.datetime(2025, 1, 1),)], "timestamp timestamp_ntz")
    none = spark.createDataFrame([], "table string, reason string")
    assert evidence.engine_context({"transactions": tx}, none)[1].first()[0] == dt.datetime(2025, 1, 2)
    with pytest.raises(ValueError):
        evidence.engine_context({"transactions": tx}, spark.createDataFrame([("transactions", "x")], none.schema))


def test_texts_of_values(spark):
    one = spark.sql("select timestamp_ntz'2025-03-04 05:06:07' a, timestamp_ntz'2025-03-04 05:06:07.5' b, 90061 s, -1 m, 59 t, 0.256 p, 'a b' x, 'TXN-1' y, repeat('z', 1501) z")
    got = one.select(*map(scalar.iso_time, map(F.col, "ab")), *map(scalar.duration_text, map(F.col, "smt")), scalar.percent_text(F.col("p")), *map(scalar.safe_id, map(F.col, "xy")), F.length(scalar.payload(F.col("z"))))
    days = dt.timedelta(seconds=-1)
    assert tuple(got.first()) == ("2025-03-04T05:06:07", "2025-03-04T05:06:07.500000", "1 day, 1:01:01", str(days), "0:00:59", "25.6%", None, "TXN-1", 1501)


def test_anomalies_come_in_exact_numbers_and_episodes_hold_together(spark):
    tx = generate.transactions(spark, 4000, 60, 3, anomalies=0.05).cache()
    counts = {r["anomaly_type"]: r["count"] for r in tx.groupBy("anomaly_type").count().collect()}
    assert tx.count() == 4000 == tx.select("transaction_id").distinct().count() and counts.pop("none") == 3800
    assert counts == generate.quotas(4000, 0.05) and sum(counts.values()) == 200
    episodes = tx.filter("episode_id is not null").groupBy("anomaly_type", "episode_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("customer_id").alias("who"), F.countDistinct("receiver").alias("to"), F.countDistinct("amount").alias("amounts"),
        (F.max(F.col("timestamp").cast("timestamp").cast("long")) - F.min(F.col("timestamp").cast("timestamp").cast("long"))).alias("s")).collect()
    for r in episodes:
        size, seconds = generate.EPISODES[r["anomaly_type"]]
        assert r["n"] <= size and r["who"] == 1 and r["to"] == 1 and r["s"] <= seconds and (r["anomaly_type"] != "repeated" or r["amounts"] == 1)
    assert rows(tx.select("transaction_id", "amount")) == rows(generate.transactions(spark, 4000, 60, 3, anomalies=0.05).repartition(7).select("transaction_id", "amount"))


def test_row_numbers_and_quoted_line_ends(spark, tmp_path):
    for name, n in (("a", 3), ("b", 500)):
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "".join(f'{name}{i},"line\nend, ""{i}"""\n' for i in range(1, n + 1)))
    got = sources.read_raw(spark, str(tmp_path), ["x", "y"]).collect()
    assert len(got) == 503 and all(int(r["x"][1:]) + 3 * (r["x"][0] == "b") == r["_row_number"] and r["y"] == f'line\nend, "{r["x"][1:]}"' for r in got)


def test_links_out_of_the_folder_are_rejected(spark, tmp_path):
    inside, outside = tmp_path / "kb", tmp_path / "secret.md"
    inside.mkdir()
    outside.write_text("secret")
    (inside / "b.md").write_text("b")
    (inside / "a.md").write_text("a")
    os.symlink(outside, inside / "c.md")
    good, bad = knowledge.load(spark, str(inside))
    assert [r["text"] for r in good.collect()] == ["a", "b"] and [r["reason"] for r in bad.collect()] == ["outside_folder"]


def test_cases_are_reconciled_at_their_own_time(spark):
    at = lambda d: dt.datetime(2025, 1, d)
    tx = spark.createDataFrame([("T1", "c", at(1), 10.0, "USD", "R")], "transaction_id string, customer_id string, ts timestamp_ntz, amount double, currency string, reference_id string")
    led = spark.createDataFrame([("L1", "T1", 10.0, "USD", at(1), "pending", "R")], "ledger_id string, transaction_id string, posted_amount double, currency string, posting_ts timestamp_ntz, status string, reference_id string")
    cases = spark.createDataFrame([(1, "T1", at(2)), (2, "T1", at(20))], "case_id int, transaction_id string, as_of timestamp_ntz")
    got = reconcile.reconcile_cases(cases, tx, led).select("case_id", F.transform("findings", lambda f: f["rule_id"]).alias("r"))
    assert rows(got) == [(1, []), (2, ["REC-010"])]
    assert [len(r["postings"]) for r in reconcile.with_postings(tx, led.unionByName(led)).collect()] == [2]
    assert reconcile.with_postings(tx, led.limit(0)).first()["postings"] == []


def test_a_store_fetches_and_counts(spark):
    docs = spark.createDataFrame([(1, "trusted"), (2, "untrusted"), (3, "trusted")], "doc_id int, trust string")
    assert rows(retrieval.fetched(docs, docs.filter("doc_id > 1").unionByName(docs.filter("doc_id = 3")))) == [(2, "untrusted"), (3, "trusted")]
    assert rows(retrieval.stored(docs)) == [(3, 2)]


def test_scores_with_a_threshold_from_validation(spark):
    data = spark.range(900).select(F.col("id").alias("transaction_id"), (F.col("id") % 10 == 0).cast("int").alias("label"), (F.rand(3) + F.when(F.col("id") % 10 == 0, 2.0).otherwise(0.0)).alias("log_amount"), F.rand(4).alias("z"),
                                   F.when(F.col("id") < 540, "train").when(F.col("id") < 720, "validation").otherwise("test").alias("split")).cache()
    got = models.scoring_service(data, ["log_amount", "z"])
    test = got.filter("split = 'test'")
    # The threshold is the least score of validation's positives, so single positives of the test may lie below it.
    assert 15 <= test.filter("flagged and label = 1").count() <= 18 == test.filter("label = 1").count() and test.filter("flagged and label = 0").count() == 0
    assert got.filter("in_training_period").count() == 540 and got.first()["drivers"][0]["feature"] == "log_amount"


def test_amounts_as_text(spark):
    got = spark.sql("select 2.675D a, -1.5D b, 0D c").select(*[scalar.amount_text(F.col(c), signed=True) for c in "abc"], scalar.amount_text(F.lit(1234.5)))
    assert tuple(got.first()) == ("+2.68", "-1.50", "+0.00", "1234.50")
