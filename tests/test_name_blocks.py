"""Jaro-Winkler of names in blocks against pair by pair."""

import random

import pytest

from sparkcase.functions.similarity import indel, jaro_winkler, jaro_winkler_block
from sparkcase.operators import fuzzyjoin, resolution
from sparkcase.plans import QUERIES


@pytest.mark.parametrize("letters", ["ab", "abc é\U0001f600", "abcdefgh"])
@pytest.mark.parametrize("longest", [3, 9, 30, 70])
def test_blocks_equal_pairs(letters, longest):
    rng = random.Random(longest)
    left, right = ([*("".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)), "", "a", "ab" * 32, "a" * 65] for n in (30, 120))
    right += left[:5]
    scores = jaro_winkler_block(left, right)
    assert all(scores[i, j] == jaro_winkler(a, b) for i, a in enumerate(left) for j, b in enumerate(right))


def test_every_row_of_a_key_meets_every_other_in_small_blocks(spark):
    """One key holds most rows and meets in 6 x 9 blocks; null names and keys without a partner meet nothing."""
    name = lambda i: f"name {i % 17} {i}" if i % 9 else f"name {i % 3}"
    left = [(i, name(i), "k" if i % 10 else "m") for i in range(60)] + [(60, None, None), (61, "x", "alone"), (62, None, "k")]
    right = [(i, name(i + 3), "k" if i % 20 else "m") for i in range(90)] + [(90, "y", None), (91, "z", "other")]
    a = spark.createDataFrame(left, "left_id long, name string, key string")
    b = spark.createDataFrame(right, "right_id int, name string, key string")
    df = resolution.jaro_winkler_within(a, b, 10, 10)
    assert df.dtypes == [("left_id", "bigint"), ("right_id", "int"), ("score", "double")]
    found = sorted(tuple(r) for r in df.collect())
    assert found == sorted((i, j, jaro_winkler(x, y)) for i, x, k in left for j, y, n in right if x is not None and k == n)
    assert resolution.jaro_winkler_within(a.limit(0), b).collect() == []


@pytest.mark.parametrize("block_entries,block_queries", [(40, 15), (8_192, 2_048)])
def test_fuzzy_blocks_equal_all_pairs(spark, block_entries, block_queries):
    """Texts of frequent letter pairs, with lengths round one word of bits, beyond it, and too short to share a pair."""
    rng = random.Random(5)
    base = ["".join(rng.choice("ab cé") for _ in range(n)).strip() for n in (60, 63, 64, 65, 70, 12, 5, 3)]
    edit = lambda t, n: "".join(c for c in t if rng.random() > n / 40) + rng.choice(["", "a", "b"])
    names = [" ".join(sorted(edit(rng.choice(base), rng.randint(0, 8)).split())) for _ in range(150)] + ["a" * 64, "a" * 63 + "b", "", "\U0001f600" * 20]
    frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} int, name string")
    found = fuzzyjoin.matches(frame(names[::3], "q"), frame(names, "e"), 0.8, block_entries=block_entries, block_queries=block_queries)
    want = {(a, b, indel(a, b)) for a in names[::3] for b in names if indel(a, b) >= 0.8}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_best_customers_of_repeated_names(spark):
    """Names with many customers, customers and queries with several names."""
    rng = random.Random(2)
    names = ["red bolt", "bolt red", "red bolts", "rod bolt", "old anvil", "old anvils", "hot ring"]
    entries = spark.createDataFrame([(rng.randint(0, 80), rng.choice(names)) for _ in range(300)] + [(90, None)], "customer_id int, name string")
    queries = spark.createDataFrame([(i // 2, rng.choice(names)) for i in range(30)] + [(99, None), (98, "zz")], "query_id int, name string")
    every = resolution.top(fuzzyjoin.join(queries, entries, 0.75), 4)
    found = fuzzyjoin.best(queries, entries, 0.75, 4)
    assert found.columns == every.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect())) and every.count() == 60
    # Before the ids of a name multiply, each name has brought its four first customers at most.
    assert fuzzyjoin.best(queries, entries, 0.75, 1).filter("rank > 1").count() == 0


def test_trigrams_of_parts_are_counted_without_a_table_of_both(spark, tmp_path):
    """Keys that come twice, null keys and null names count as in SQL; no aggregate holds pairs of trigram and part."""
    rows = [(1, "red red"), (1, "red bolt"), (2, "red"), (None, "red"), (3, None), (4, ""), (None, "a")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["trigram_stats"](spark, str(tmp_path))
    found = {r["gram"]: (r["n"], r["parts"]) for r in df.collect()}
    assert found == {"^re": (5, 2), "red": (5, 2), "ed$": (5, 2), "^bo": (1, 1), "bol": (1, 1), "olt": (1, 1), "lt$": (1, 1), "^a$": (1, 0)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("[", 1)[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert keys and not any("gram" in k and "p_partkey" in k for k in keys)
