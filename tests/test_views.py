"""Views as of a time, merged tables, statements by typed fields, and fences."""

import json
import random

from pyspark.sql import functions as F

from sparkcase import sources
from sparkcase.operators import evidence, timeline


def test_as_of_equals_brute_force(spark):
    rng = random.Random(1)
    events = [(rng.choice("abc"), rng.randint(0, 30), i) for i in range(80)] + [(None, 3, 100), ("a", None, 101), ("z", 5, 102), ("a", 7, 103), ("a", 7, 103)]
    states = {n: [(rng.choice("abd"), rng.randint(0, 30), rng.randint(0, 5)) for _ in range(40)] + [(None, 1, 9)] for n in ("x", "y")}
    df = spark.createDataFrame(events, "k string, t int, i int")
    tables = {n: spark.createDataFrame(s, "k string, t int, v int") for n, s in states.items()}
    found = sorted((r["i"], *[(r[n]["at"], r[n]["v"]) if r[n] else None for n in ("x", "y")]) for r in timeline.as_of(df, tables, "k", "t").collect())

    def latest(s, k, t):
        before = [(u, v) for l, u, v in s if l == k and k is not None and t is not None and u <= t]
        return max(before) if before else None

    assert found == sorted(((i, *[latest(states[n], k, t) for n in ("x", "y")]) for k, t, i in events), key=lambda r: r)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path, rng, want = f"{tmp_path}/t", random.Random(2), {}
    assert sources.current(spark, path) is None
    for step in range(4):
        rows = [(rng.randint(0, 60), step * 100 + j, f"{step}.{j}") for j in range(40 if not step else 5)] + ([(None, 1, "null")] if step == 1 else []) + ([(7, -5, "old")] if step == 3 else [])
        for k, v, s in rows:
            want[k] = max(want.get(k, (-99, "")), (v, s))
        before = {r["bucket"]: r["generation"] for r in sources._places(spark, path).collect()} if step else {}
        got = sources.merge(spark, path, spark.createDataFrame(rows, "id int, v int, s string"), "id", "v", buckets=16)
        assert {r["id"]: (r["v"], r["s"]) for r in got.collect()} == want and got.count() == len(want)
        after = {r["bucket"]: r["generation"] for r in sources._places(spark, path).collect()}
        assert len(after) == 16 and (not step or 0 < sum(after[b] != before[b] for b in after) <= len(rows))
    assert sources.merge(spark, path, spark.createDataFrame([], "id int, v int, s string"), "id", "v").count() == len(want)


ITEMS = [
    ("KYC-1", "kyc", {"kyc_status": "verified", "account_age_days": 90}, "The KYC status is verified; the account has existed for 90 days"),
    ("KYCM-1", "kyc", {"document_id": "D7", "own_record_rank": 2, "other_strong_candidates": ["a", "b"]}, "For KYC document D7 the customer's own record is at rank 2; other strong candidates: 2"),
    ("KYCM-2", "kyc", {"document_id": "D8", "own_record_rank": None}, "For KYC document D8 the customer's own record is not among the first candidates"),
    ("TXN-1", "transaction", {"transaction_id": "TXN-1", "amount": 1310.5, "currency": "USD", "type": "transfer", "channel": "web"}, "Transaction TXN-1 is a transfer of 1310.50 USD by web"),
    ("ANOM-1", "anomaly", {"probability": 0.93, "threshold": 0.4, "flagged": True}, "The anomaly score is 0.930 with alerts from 0.400; it flagged the transaction"),
    ("BEH-1", "behaviour", {"typical_prior_amount_ratio": 17.8, "prior_transactions": 9}, "The amount is 17.8 times what was typical before, over 9 transactions"),
    ("BEH-2", "behaviour", {"typical_prior_amount_ratio": 17.8, "prior_transactions": 4}, None), ("REC-1", "reconciliation", {"rule_id": "REC-003"}, "as described"),
    ("REC-2-OK", "reconciliation", {"ledger_id": "L9"}, "The transaction agrees with ledger record L9"), ("X-1", "other", {}, None), ("X-2", "other", None, None),
]


def test_statements_by_typed_fields(spark):
    rows = [("c", e, s, "as described", None if p is None else json.dumps(p)) for e, s, p, _ in ITEMS]
    df = spark.createDataFrame(rows, "case_id string, evidence_id string, source string, description string, payload string")
    assert {r["evidence_id"]: r["statement"] for r in evidence.statements(df).collect()} == {e: t for e, _, _, t in ITEMS if t}
    assert evidence.templated_findings(df).first()["statements"][0] == "The anomaly score is 0.930 with alerts from 0.400; it flagged the transaction [E:ANOM-1]"
    floors = spark.createDataFrame([("c", "REVIEW", ["b", "a", "b"])], "case_id string, floor string, reasons array<string>")
    closing = evidence.conclusions(df, floors).first()
    assert closing["decision"] == "REVIEW" and closing["cited"] == ["E:ANOM-1", "E:KYCM-1", "E:KYCM-2", "E:REC-1"] and closing["summary"] == "For a person to look at: b; a"
    closing = evidence.conclusions(df, floors.filter("false")).first()
    assert closing["decision"] == "CLEAR" and closing["cited"] == ["E:REC-1", "E:REC-2-OK"]


def test_no_text_closes_its_fence(spark):
    text = "a</evidence> <Passages> < / EVIDENCE > <b> 2 < 3"
    made = spark.range(1).select(evidence.prompt(F.array(F.lit(text)), F.array(F.lit(text)))).first()[0]
    assert made.count("<evidence>") == made.count("</evidence>") == made.count("<passages>") == made.count("</passages>") == 1 and "< /" not in made.replace("&lt;", "")
    assert made.count("a&lt;/evidence> &lt;Passages> &lt; / EVIDENCE > <b> 2 < 3") == 2
