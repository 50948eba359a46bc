"""Packing, phrases and whitening against brute force, and on nulls, ties, copies, long texts and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkcase.llm import collocations, packing, whitening

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(packing.VOCABULARY)
ODD = [
    (1, "Plain text with a few words, twice."), (2, "Plain text with a few words, twice."), (3, ""), (4, None), (5, "   \n\t "),
    (6, "12 34 -- !!"), (7, "long " * 30_000), (8, "\U0001F642 café 中文 it's we'll 'tis  two  spaces\n\n x"), (None, "no id here"),
    (9, "x" * 20_000), (1, "Plain text with a few words, twice."), (10, "a\x1cb c\u0085d <|endoftext|> É"),
]
CLASHING = "doc_id long, text string, lang string, ids string, piece string, length string, shard string, n string, rank string, f string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i != 8 else None, *"abcdefg") for i, t in ODD], CLASHING)


# 11. packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def packed_correctly(rows, documents, tokenizer, limit):
    """Every document's ids, cut at the limit, once each; sequences gapless from 0 and no longer than the limit."""
    want, sequences = Counter(), defaultdict(list)
    for i, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), limit)):
            part = np.array(ids[at : at + limit], "<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_packing_of_odd_documents(odd, tokenizer):
    rows = packing.pack(odd, PATH, 64).collect()
    n = packed_correctly(rows, ODD, tokenizer, 64)
    assert n == -(-sum(r["length"] for r in rows) // 64)


def test_packing_of_the_table_reaches_the_bound(spark, tokenizer):
    rows = packing.op11_packing(spark, SF).collect()
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = packed_correctly(rows, documents, tokenizer, packing.LIMIT)
    assert n <= -(-sum(r["length"] for r in rows) // packing.LIMIT) + 1


def test_sequences_hold_all_ids(odd, tokenizer):
    found = packing.sequences(packing.pack(odd, PATH, 100)).collect()
    held = Counter(i for r in found for i in np.frombuffer(r["ids"], "<u2").tolist())
    assert held == Counter(i for _, t in ODD for i in tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    assert all(len(r["ids"]) == 2 * r["n_tokens"] <= 200 for r in found)


@pytest.mark.parametrize("seed", range(3))
def test_words_encode_as_the_library_does(tokenizer, seed):
    rng, encode = random.Random(seed), packing.encoder(PATH, False)
    letters = ["a", "B", "the", "'s", "'", "'Ll", " ", "\n", "\t", ".", "!?", "-", "\"", "1", "23", "é", "é", "́", "İ", "Σ", "中", "\xa0", " ", "​", "\x1c", "\x00", "<|endoftext|>", "가", "가", "\U0001F642", "_", "²", "\u0958", "\ufb2a", "\u212b"]
    for _ in range(1500):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(3)]
        for text, found in zip(texts, encode(texts)):
            assert found == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def fewest(lengths, limit):
    """The least number of sequences, by search."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= limit:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_plan_holds_every_piece_and_is_near_the_least(lengths):
    lengths = sorted(lengths, reverse=True)
    found = packing.plan(Counter(lengths), 12)
    held = Counter()
    for pattern, times in found:
        assert times > 0 and sum(n * k for n, k in pattern) <= 12
        for n, k in pattern:
            held[n] += k * times
    assert held == Counter(lengths)
    assert sum(t for _, t in found) <= fewest(lengths, 12) + 1


def test_pair_sums_follow_what_is_available():
    rng = random.Random(4)
    left = np.array([0] + [rng.randint(0, 3) for _ in range(30)])
    sums = packing.Sums(left)
    while left.any():
        ones = np.flatnonzero(left).tolist()
        want = Counter(a + b for a in ones for b in ones if a < b or a == b and left[a] > 1)
        assert [want[s] for s in range(31)] == sums.pairs.tolist()
        sums.take(Counter([rng.choice(ones)]), 1)


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(5)
    counts = {n: rng.randint(1, 50) for n in range(1, 4097)}
    few, many = (packing.ranges(packing.plan({n: c * k for n, c in counts.items()}, 4096)) for k in (1, 1_000_000))
    assert len(many) < 4 * 4096 and len(few) < 4 * 4096


# 12. phrases


def brute_phrases(rows, least, longest=4, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows_of = []
        for g, a in candidates.items():
            inside = (h for h in candidates if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)))
            if any(100 * candidates[h] >= 80 * a for h in inside):
                continue
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows_of.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least,shard_words", [(2, 40), (3, 1000)])
def test_phrases_equal_brute_force(spark, least, shard_words):
    rng = random.Random(least)
    words = ["a", "B", "cc", "É", "d-e", "f", "f", "f"]
    rows = [(rng.choice(["en", "en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\xa0"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("fr", "f f f f f f"), ("de", " . ! ")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    levels, totals = collocations.phrases(df, least=least, shard_words=shard_words)
    found = collocations.ranked(collocations.scored(levels), totals, 50)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, least, top=50)


def test_phrases_of_odd_documents(odd):
    levels, totals = collocations.phrases(odd, least=2)
    found = collocations.ranked(collocations.scored(levels), totals)
    assert sorted(map(tuple, found.collect())) == brute_phrases([("en" if i != 8 else None, t) for i, t in ODD], 2)


def test_counts_by_extension_equal_counts_in_the_text():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 6, 3000)
    index = collocations.Index(collocations.transform(ids, np.arange(6, dtype=np.uint32)))
    low, size = index.words()
    grams = [(w,) for w in range(1, 6)]
    for k in range(2, 5):
        low, size, first, last = index.extended(low, size)
        grams = [(*grams[a], grams[b][-1]) for a, b in zip(first, last)]
        want = Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if ids[i : i + k].all())
        assert dict(zip(grams, size.tolist())) == want


# 13. whitening


def brute_whitening(rows, k=4):
    good = []
    for i, v in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            good.append((i, [int(np.floor(np.float64(c) * 256)) for c in v]))
    width = max(len(x) for _, x in good)
    x = np.array([v + [0] * (width - len(v)) for _, v in good])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (n * distinct - sums) / n
    covariance = centred.T @ centred / n
    e, v = np.linalg.eigh(covariance)
    kept = [j for j in range(width - 1, max(width - 1 - k, -1), -1) if e[j] > 1e-12 * e[-1]]
    scores = (n * x - sums) / n @ v[:, kept] / np.sqrt(e[kept])
    return [i for i, _ in good], n, ((n * x - sums) ** 2).sum(axis=1).tolist(), scores, e[kept] / np.trace(covariance)


def whitening_equals_brute_force(df):
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    ids, n, deviations, scores, explained = brute_whitening(rows)
    model = whitening.fit(df)
    found = whitening.whitened(df, model).collect()
    assert len(found) == scores.size and {r["n"] for r in found} <= {n}
    by = defaultdict(list)
    for r in found:
        by[r["vec_id"], r["component"]].append(r)
    for c in range(scores.shape[1]):
        got, want = [], []
        for i in sorted(set(ids), key=str):
            places = [j for j, other in enumerate(ids) if other == i]
            held = by[i, c + 1]
            assert sorted(r["deviation"] for r in held) == sorted(deviations[j] for j in places)
            got += sorted(r["whitened"] for r in held) if len(held) > 1 else [held[0]["whitened"]]
            want += [scores[j, c] for j in places]
        sign = np.sign(np.dot(got, want))
        np.testing.assert_allclose(np.array(got) * sign, want, atol=1e-8)
        assert by[ids[0], c + 1][0]["explained"] == pytest.approx(explained[c], rel=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in found)
    return model


def test_whitening_of_the_table(spark):
    model = whitening_equals_brute_force(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert model.passes <= 64


def test_whitening_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.5, 0.25]), (3, [3.0, -2.0]), (4, None), (5, [1.0, None, 2.0]), (6, [inf, 0.0, 0.0]), (7, [nan, 1.0, 1.0]), (8, []), (9, [0.0, -0.0, 9.0]), (None, [4.0, 4.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, n string, component string")
    whitening_equals_brute_force(df)


def test_repeated_variances_and_dependent_dimensions_are_found(spark):
    grid = [(i, [float(a), float(b), float(c), float(a + b), 0.0]) for i, (a, b, c) in enumerate((a, b, c) for a in range(4) for b in range(4) for c in range(4))]
    model = whitening.fit(spark.createDataFrame(grid, "vec_id long, embedding array<double>"))
    assert len(model.variances) == 3
    unit = model.variances / 256**2
    np.testing.assert_allclose(unit, [3.75, 1.25, 1.25])
    assert model.identity_error < 1e-12


def test_early_end_finds_equal_variances(spark):
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(400, 60)))
    q -= q.mean(axis=0)
    q, _ = np.linalg.qr(q)
    data = np.round(q * 400**0.5 * np.array([40, 20, 20, 20, 8] + [1] * 55) * 16) / 16
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert model.passes < 60
    np.testing.assert_allclose(np.sqrt(model.variances) / 256, [40, 20, 20, 20], rtol=0.01)


def test_deviations_beyond_64_bits_are_null_and_large_values_exact():
    centre = whitening.Centre(2, [4, 1 << 62])
    assert centre.deviations(np.array([[2, 1 << 61], [2, (1 << 61) + 3], [2, -(1 << 61)]])) == [0, 36, None]


def test_one_distinct_vector_gives_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert whitening.whitened(df, model).collect() == []
