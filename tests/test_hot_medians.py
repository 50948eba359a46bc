"""Running medians: keys that are split over tasks give what heaps over the whole history give."""

import random
from statistics import median

import pytest

from sparkcase.operators import history


def brute(rows):
    """The median of the values of the same key at strictly earlier times; null times come first of all."""
    out = []
    for k, t, x, i in rows:
        before = [y for l, u, y, _ in rows if l == k and y is not None and (u is None and t is not None or u is not None and t is not None and u < t)]
        out.append((i, median(before) if before else None))
    return sorted(out)


@pytest.mark.parametrize("most,kind", [(40, "random"), (40, "rising"), (40, "falling"), (25, "ties"), (7, "random"), (100_000, "random")])
def test_split_keys_equal_brute_force(spark, most, kind):
    rng, rows = random.Random(most), []
    for i in range(500):
        key = "hot" if i % 3 else f"k{rng.randint(0, 6)}"
        t = rng.randint(0, 40) if kind == "ties" else rng.randint(0, 100_000)
        x = {"random": rng.gauss(0, 50), "rising": t / 7.0, "falling": -t * 1.5, "ties": float(rng.randint(0, 3))}[kind]
        rows.append((key, None if i == 9 else t, None if rng.random() < 0.1 else x, i))
    rows += [(None, 5, 1.0, 1000), (None, 6, 2.0, 1001)]
    df = spark.createDataFrame(rows, "customer string, micros long, amount double, i long")
    found = history.with_prior_median(df, "amount", most=most)
    assert found.columns == ["customer", "micros", "amount", "i", "typical"]
    got = sorted((r["i"], r["typical"]) for r in found.collect())
    want = brute([r for r in rows if r[0] is not None]) + [(1000, None), (1001, 1.0)]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [v for _, v in got] == pytest.approx([v for _, v in want])


def test_one_key_in_twenty_times(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("a", i, rng.random()) for i in range(20_000)], "customer string, micros long, amount double").repartition(4)
    got = {r["micros"]: r["typical"] for r in history.with_prior_median(df, "amount", most=1_000).collect()}
    values = [r["amount"] for r in df.orderBy("micros").collect()]
    assert got[0] is None and all(got[m] == pytest.approx(median(values[:m])) for m in (1, 2, 999, 1_000, 10_001, 19_999))
