"""Terms that disclose an entity of one line, copies that prove nothing, and long lines of many entities."""

import time

from sparkcase.llm import pii

COMMON = [(i, "The report was sent to all in May\nusual words follow here and there") for i in range(100)]


def terms(spark, rows):
    df = spark.createDataFrame(COMMON + rows, "doc_id long, text string")
    return {r["id"]: [s["value"] for s in r["terms"]] for r in pii.found(df).collect()}


def test_a_planted_name_beside_a_one_line_entity_is_found(spark):
    got = terms(spark, [(500, "The report was sent by Ilse Quandt, iq@x.org, and all follow"), (501, "usual words\nJo (4111 1111 1111 1111) here"), (502, "here Room B12 +1 555 123 4567")])
    assert got[500] == ["Ilse", "Quandt"] and got[501] == ["Jo"] and got[502] == ["Room", "B12"] and got[0] == []


def test_what_also_stands_elsewhere_or_far_off_or_in_small_letters_is_no_name(spark):
    rows = [(500, "The report by Ilse iq@x.org"), (501, "Ilse was there"), (502, "Zoltan " + "usual words follow " * 3 + "z@x.org"), (503, "quandt q@x.org here")]
    got = terms(spark, rows)
    assert got[500] == got[501] == got[502] == got[503] == []


def test_copies_of_a_line_prove_nothing(spark):
    once = terms(spark, [(500, "we sent zanzibar to a@x.org today")])
    copied = terms(spark, [(500 + i, "we sent zanzibar to a@x.org today") for i in range(40)])
    assert once[500] == [] and all(copied[500 + i] == [] for i in range(40))
    named = terms(spark, [(500 + i, "we sent Zanzibar to a@x.org today") for i in range(40)])
    assert all(named[500 + i] == ["Zanzibar"] for i in range(40))


def test_short_terms_and_terms_with_digits_count(spark):
    got = terms(spark, [(500, "unit 7q by a@x.org was sent"), (501, "all of 7q follow a@x.org here"), (502, "b li b@x.org"), (503, "and li to b@x.org all")])
    assert got[500] == got[501] == ["7q"] and got[502] == got[503] == ["li"]


def test_two_long_lines_of_many_addresses(spark):
    """Alike but not equal: pairs grow with the length of the lines."""
    one = " ".join(f"user{i}@host{i}.org next" for i in range(12_000))
    began = time.time()
    df = spark.createDataFrame(COMMON + [(500, one), (501, one + " end")], "doc_id long, text string")
    rows = {r["id"]: r for r in pii.found(df).collect()}
    assert len(rows[500]["base"]) == len(rows[501]["base"]) == 12_000
    assert time.time() - began < 240
