"""The fuzzy join against all pairs: nothing that reaches the threshold is lost."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkcase.functions.similarity import indel
from sparkcase.operators import fuzzyjoin, resolution

COUNTS = [random.Random(0).randint(0, 9) for _ in range(fuzzyjoin.TABLE)]
TEXT = st.text("abc ", max_size=14)


@settings(max_examples=3000, deadline=None)
@given(TEXT, TEXT, st.sampled_from([0.75, 0.8, 0.85, 0.9, 0.97, 1.0]))
def test_matching_texts_share_a_key(a, b, threshold):
    if indel(a, b) >= threshold:
        assert set(fuzzyjoin.keys_of(a, COUNTS, threshold, True)) & set(fuzzyjoin.keys_of(b, COUNTS, threshold, False))


@settings(max_examples=1500, deadline=None)
@given(st.text("abcdefg ", min_size=5, max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from("xyz")), max_size=8), st.sampled_from([0.75, 0.8, 0.9]))
def test_edited_texts_share_a_key(a, edits, threshold):
    b = a
    for at, letter in edits:
        at %= len(b) + 1
        b = b[:at] + letter + b[at:] if letter != "z" else b[:at] + b[at + 1 :]
    if indel(a, b) >= threshold:
        assert set(fuzzyjoin.keys_of(a, COUNTS, threshold, True)) & set(fuzzyjoin.keys_of(b, COUNTS, threshold, False))


def in_order(name):
    return " ".join(sorted(name.split()))


@pytest.mark.parametrize("threshold,part_rows", [(0.75, 2_000), (0.85, 5), (1.0, 2_000)])
def test_join_equals_all_pairs(spark, threshold, part_rows):
    rng = random.Random(7)
    first, last = ["anna", "ann", "jon", "john", "jo", "maria", "li", "É", ""], ["smith", "smyth", "smithe", "garcia", "o", "lee", "de la cruz", "Zoë", "van  der berg"]
    names = [f"{rng.choice(first)} {rng.choice(last)}" for _ in range(150)] + ["", " ", "a", "b", None, "smith  anna", "x" * 300, "x" * 280 + "y"]
    asks = [(i, n) for i, n in enumerate(rng.sample(names[:150], 40) + ["", "a", None, "anna smith", "x" * 290])]
    q = spark.createDataFrame(asks, "query_id long, name string")
    e = spark.createDataFrame(list(enumerate(names)), "customer_id long, name string")
    found = {(r["q"], r["e"]): r["score"] for r in fuzzyjoin.matches(q, e, threshold, part_rows=part_rows).collect()}
    want = {}
    for _, a in asks:
        for b in names:
            if a is not None and b is not None and (s := indel(in_order(a), in_order(b))) >= threshold - 1e-9:
                want[in_order(a), in_order(b)] = s
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    by_id = {(r["query_id"], r["customer_id"]): r["score"] for r in fuzzyjoin.join(q, e, threshold).collect()}
    assert by_id == pytest.approx({(i, j): want[in_order(a), in_order(b)] for i, a in asks for j, b in enumerate(names) if a is not None and b is not None and (in_order(a), in_order(b)) in want})


def test_fuzzy_signal_of_given_pairs_is_exact(spark):
    pairs = spark.createDataFrame([(1, 1, "anna smith", "smith ann"), (1, 1, "anna smith", "zz"), (1, 2, "anna smith", "qqq")], "query_id long, customer_id long, q_name string, name string")
    found = {r["customer_id"]: r["score"] for r in resolution.fuzzy(pairs).collect()}
    assert found == pytest.approx({1: indel("anna smith", "ann smith"), 2: indel("anna smith", "qqq")})


def test_low_thresholds_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "query_id long, name string")
    with pytest.raises(ValueError):
        fuzzyjoin.matches(df, df, 0.5)


def test_a_sample_of_the_tables_texts_loses_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("customer_id"), F.substring("text", 1, 40).alias("name"))
    q = docs.filter("customer_id % 10 = 0").withColumnRenamed("customer_id", "query_id")
    found = {(r["query_id"], r["customer_id"]) for r in fuzzyjoin.join(q, docs, 0.75).collect()}
    names = {r["customer_id"]: in_order(r["name"]) for r in docs.collect() if r["name"] is not None}
    want = {(i, j) for i in names if i % 10 == 0 for j in names if indel(names[i], names[j]) >= 0.75}
    assert found == want and len(want) > 20
