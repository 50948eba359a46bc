"""Cleaning, normalising and tokenising text as column expressions.

Accents and Unicode normal forms have no built-in; they take an Arrow UDF, and
only for values that are not plain ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed: cells that mean "no value" (after lower-casing).
NULL_TOKENS = ("", "nan", "null", "none", "n/a")
#: Fixed: street words and their short forms.
STREET_SUFFIXES = {
    "street": "st", "st": "st", "road": "rd", "rd": "rd", "avenue": "ave", "ave": "ave", "lane": "ln", "ln": "ln",
    "drive": "dr", "dr": "dr",
}
#: Fixed: words that retrieval leaves out.
STOPWORDS = (
    "a an and are as at be by can do does for from has have how i if in into is it its of on or that the their there "
    "these this to was what when where which who why will with you your should must may not no than then so such any all each"
).split()


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def _unaccented(x: pd.Series) -> pd.Series:
    def strip(s):
        return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    return x.map(strip)


def _ascii(x: Column) -> Column:
    return ~x.rlike(r"[^\x00-\x7F]")


def nfc(x: Column) -> Column:
    return F.when(_ascii(x), x).otherwise(_nfc(x))


def strip_accents(x: Column) -> Column:
    return F.when(_ascii(x), x).otherwise(_unaccented(x))


def squeezed(x: Column) -> Column:
    """Trimmed, with each run of white space as one blank."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_cell(x: Column, unicode: bool = True) -> Column:
    """A raw cell in canonical form, or null where it says that there is no value."""
    text = squeezed(nfc(x) if unicode else x)
    return F.when(~F.lower(text).isin(*NULL_TOKENS), text)


def cell_actions(x: Column) -> dict[str, Column]:
    """Whether cleaning a cell trims it, collapses its white space, or empties it."""
    trimmed = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return {
        "trim_whitespace": x != trimmed,
        "collapse_whitespace": trimmed != F.regexp_replace(trimmed, r"(?U)\s+", " "),
        "null_token_to_none": F.lower(squeezed(x)).isin(*NULL_TOKENS),
    }


def pipe_list(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x, r"\|"))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def name_parts(x: Column, unicode: bool = True) -> Column:
    """struct<canonical, tokens, first, middle, last, has_initials, reordered>; tokens are empty if none is usable."""
    text = F.lower(strip_accents(x) if unicode else x)
    surname, rest = F.substring_index(text, ",", 1), F.regexp_replace(text, "^[^,]*,", "")
    swap = F.contains(text, F.lit(",")) & (F.trim(surname) != "") & (F.trim(rest) != "")
    ordered = F.when(swap, F.concat_ws(" ", rest, surname)).otherwise(text)
    tokens = words(F.regexp_replace(ordered, r"[^\p{L}\p{N}\s'_-]", " "))
    n = F.size(tokens)
    return F.struct(
        F.array_join(tokens, " ").alias("canonical"), tokens.alias("tokens"), F.get(tokens, F.lit(0)).alias("first"),
        F.slice(tokens, 2, F.greatest(n - 2, F.lit(0))).alias("middle"), F.get(tokens, n - 1).alias("last"),
        F.exists(tokens, lambda t: F.length(t) == 1).alias("has_initials"), swap.alias("reordered"),
    )


def address_parts(x: Column, unicode: bool = True) -> Column:
    """struct<canonical, parsed, number, street, city, country> of "number street, city, CC"; else kept as text."""
    text = squeezed(strip_accents(x) if unicode else x)
    pattern = r"^([0-9]+)\s+([^,]+),\s*([^,]+),\s*([A-Za-z]{2})$"
    parsed = text.rlike(pattern)

    def part(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit("."), F.lit(""))), r"\s+", " "))

    short = F.create_map(*[F.lit(v) for pair in STREET_SUFFIXES.items() for v in pair])
    street = plain(part(2))
    last = F.substring_index(street, " ", -1)
    street = F.concat(F.substring(street, F.lit(1), F.length(street) - F.length(last)), F.coalesce(F.try_element_at(short, last), last))
    city, country = plain(part(3)), F.upper(part(4))
    whole = F.concat(part(1), F.lit(" "), street, F.lit(", "), city, F.lit(", "), country)
    return F.struct(
        F.when(parsed, whole).otherwise(F.lower(F.replace(text, F.lit("."), F.lit("")))).alias("canonical"), parsed.alias("parsed"),
        F.when(parsed, part(1)).alias("number"), F.when(parsed, street).alias("street"),
        F.when(parsed, city).alias("city"), F.when(parsed, country).alias("country"),
    )


def document_number(x: Column) -> Column:
    """Letters and digits in upper case; null if there is none."""
    kept = F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    return F.when(kept != "", kept)


def slug(x: Column) -> Column:
    found = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(found == "", F.lit("section")).otherwise(found)


def search_tokens(x: Column) -> Column:
    """Lower-case words and hyphenated ids without stop-words, repeats kept."""
    found = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def trigrams(x: Column) -> Column:
    """Three-letter runs of ^word$ for each word; a shorter padded word is one run."""
    def runs(w: Column) -> Column:
        padded = F.concat(F.lit("^"), w, F.lit("$"))
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))
        return F.when(F.length(padded) < 3, F.array(padded)).otherwise(many)

    return F.flatten(F.transform(words(x), runs))


def sentences(x: Column) -> Column:
    """Lines, each cut after . ! or ? before white space."""
    lines = F.filter(F.transform(F.split(x, r"\R"), lambda s: squeeze_ends(s)), lambda s: s != "")
    return F.filter(F.flatten(F.transform(lines, lambda s: F.split(s, r"(?U)(?<=[.!?])\s+"))), lambda s: s != "")


def squeeze_ends(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_document(x: Column, unicode: bool = True) -> Column:
    """Without HTML comments, invisible and control characters, trailing blanks, and more than one empty line."""
    steps = [
        (r"(?s)<!--.*?-->", ""), (r"\r\n?", "\n"), ("[­​-‏‪-‮⁠-⁤⁦-⁩﻿]", ""),
        (r"[\x00-\x08\x0b-\x1f\x7f]", ""), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n"),
    ]
    text = nfc(x) if unicode else x
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^\s+|\s+$", "")
