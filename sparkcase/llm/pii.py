"""Personal data: patterns, and terms that disclose them by co-occurrence.

Base spans of four kinds (email, ip, card, phone) come from patterns and their
checks. No pattern matches a line's end, so spans are looked for line by line,
in the lines that can hold one. The method then adds information-theoretic
spans: a protected entity is a base span's value, its contexts are the lines
that hold it. For a term t that stands within REACH code points of entity c, the
corpus gives the pointwise mutual information
    PMI(c; t) = log2(N * n(c, t) / (n(c) * n(t))),
n counting lines of all documents (a line once, however often it holds c or t;
terms inside base spans are not near c), and c's own information log2(N / n(c)).
A term whose PMI reaches DISCLOSURE of the entity's information reveals it: its
occurrences in the entity's lines become spans of kind `term`. So that chance
proves nothing, a term must share SUPPORT different lines with c, or be a name: a
word that begins with a capital within NEAR code points of c, and in no line of
the corpus but c's. Copies of a line are one line here, and add nothing.
sanitised() then generalises the terms and removes the base values.

Only DataFrame and SQL functions are used. Lines with an entity are collapsed to
different lines with counts before anything is paired. An occurrence of an entity
is paired with the terms in its reach alone, so a very long line of many values
gives pairs in proportion to its length. n(t) is counted over all lines of the
corpus, summed within each task before terms are shuffled, if any pair is left.

Positions are code points, ends exclusive. Nulls: a null text is an empty one;
a null id is kept. Repeated rows get the same spans. An empty table gives no
rows. Columns named like the outputs are replaced, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Possessive forms match the same text without
#: recursion; a start inside a run can only follow a match's end (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no span of the kind.
HINTS = {
    "email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]",
}
TERM = r"[\p{L}\p{N}]++"
NAME = r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{N}]++"
DISCLOSURE = 0.9
SUPPORT = 2
#: Code points on either side of an entity in which terms, and names that need no second line, are near it.
REACH, NEAR = 200, 40
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running sums (or maxima, as combine says) of an array of positions.

    In groups of about the root of the array's size, as appending one by one would copy the whole array each time.
    """
    def within(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return _bound(combine(acc["at"], x).cast("int"), lambda v: F.struct(v.alias("at"), F.array_append(acc["out"], v).alias("out")))

        return F.aggregate(part, start, step, lambda acc: acc["out"])

    def grouped(v: Column) -> Column:
        k = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
        groups = F.transform(F.sequence(F.lit(0), F.size(v) - 1, k), lambda i: F.slice(v, i + 1, k))

        def joined(parts: Column) -> Column:
            totals = within(F.transform(parts, lambda g: F.aggregate(g, F.lit(0), lambda a, x: combine(a, x).cast("int"))), F.lit(0))
            return _bound(totals, lambda t: F.flatten(F.transform(parts, lambda g, j: within(g, F.when(j > 0, F.get(t, j - 1)).otherwise(0)))))

        return F.when(F.size(v) > 0, _bound(groups, joined)).otherwise(F.array().cast("array<int>"))

    return _bound(values, grouped)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def located(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern as structs (kind, start, end, value), leftmost first."""
    def spans(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = _running(F.zip_with(found, between, lambda m, gap: F.length(m) + F.length(gap)), _sum)
        return F.zip_with(found, ends, lambda m, end: F.struct(
            F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))

    return F.when(text.rlike(pattern), _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _hinted(text: Column) -> Column:
    hit = F.lit(False)
    for k in KINDS:
        hit = hit | text.rlike(HINTS[k])
    return hit


def base_spans(line: Column) -> Column:
    """The base spans of one line by kind as listed, then start."""
    none = F.array().cast(_SPAN)

    def of(kind: str) -> Column:
        valid = F.filter(located(line, PATTERNS[kind], kind), lambda s: _valid(kind, s["value"]))
        return F.when(line.rlike(HINTS[kind]), valid).otherwise(none)

    return F.concat(*map(of, KINDS))


def _shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))


def hit_lines(text: Column) -> Column:
    """The lines of a text that have base spans: structs (start, line, spans), spans by their places in the line."""
    def of(lines: Column) -> Column:
        ends = _running(F.transform(lines, lambda x: F.length(x) + 1), _sum)
        placed = F.zip_with(lines, ends, lambda x, end: F.struct((end - F.length(x) - 1).alias("start"), x.alias("line")))
        found = F.transform(F.filter(placed, lambda x: _hinted(x["line"])), lambda x: F.struct(x["start"].alias("start"), x["line"].alias("line"), base_spans(x["line"]).alias("spans")))
        return F.filter(found, lambda x: F.size(x["spans"]) > 0)

    none = F.array().cast(f"array<struct<start:int,line:string,spans:{_SPAN}>>")
    return F.when(_hinted(text), _bound(F.split(text, "\n", -1), of)).otherwise(none)


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["value"])


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)))


def context_lines(hits: DataFrame) -> DataFrame:
    """The different lines of hits (line, spans): line, n (how many rows have it), spans, entities, and masked, the line with its base spans blank."""
    lines = hits.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.first("spans").alias("spans"))
    masked = replaced(F.col("line"), F.col("spans"), lambda s, before: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], before))))
    return lines.select("line", "n", "spans", F.array_distinct(F.transform("spans", _entity)).alias("entities"), masked.alias("masked"))


#: Code points of the pieces in which a line is looked up, more than REACH.
_PIECE = 2_048


def _pieces(line: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(line) / _PIECE).cast("int")), lambda i: line.substr(i * _PIECE + 1, F.lit(_PIECE)))


def _around(pieces: Column, size: Column, span: Column, reach: int) -> Column:
    """What stands within reach of a span on either side in a line of this size, without words that are cut off."""
    def two(first: Column) -> Column:
        return F.concat(*[F.coalesce(F.get(pieces, first + i), F.lit("")) for i in (0, 1)])

    at = F.greatest(F.floor(span["start"] / _PIECE).cast("int") - 1, F.lit(0))
    begin = F.greatest(span["start"] - reach, F.lit(0))
    before = two(at).substr(begin - at * _PIECE + 1, span["start"] - begin)
    last = F.floor(span["end"] / _PIECE).cast("int")
    after = two(last).substr(span["end"] - last * _PIECE + 1, F.lit(reach))
    before = F.regexp_replace(before, F.when(begin > 0, r"^[\p{L}\p{N}]+").otherwise("^$"), F.lit(""))
    after = F.regexp_replace(after, F.when(size > span["end"] + reach, r"[\p{L}\p{N}]++$").otherwise("^$"), F.lit(""))
    return F.concat_ws("\n", before, after)


def disclosing_terms(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, terms) for lines as context_lines gives them, written with a number `at` each, and all texts (text)."""
    own = written(lines.select("n", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("n").alias("n_c")), "entities")
    # What is round each span is cut out before spans become rows, so that no row holds the line.
    cuts = _bound(_pieces(F.col("masked")), lambda p: F.transform("spans", lambda s: F.struct(
        _entity(s).alias("entity"), _around(p, F.col("size"), s, REACH).alias("reach"), _around(p, F.col("size"), s, NEAR).alias("near"))))
    met = lines.withColumn("size", F.length("masked")).select("at", "n", F.explode(cuts).alias("c")).select(
        "at", "n", "c.entity", _terms(F.col("c.reach")).alias("terms"), F.transform(F.regexp_extract_all("c.near", F.lit(NAME), F.lit(0)), F.lower).alias("names"))
    pairs = met.select("at", "n", "entity", "names", F.explode("terms").alias("term")).groupBy("at", "entity", "term").agg(
        F.first("n").alias("n"), F.max(F.array_contains("names", F.col("term"))).alias("named"))
    joint = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), (F.count(F.lit(1)) >= SUPPORT).alias("often"), F.max("named").alias("named"))
    joint = written(joint.filter(F.col("often") | F.col("named")), "joint")
    if not joint.take(1):
        return own.filter("false").select("entity", F.array().cast("array<string>").alias("terms"))
    every = texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    words = every.select(F.explode(_terms(F.col("line"))).alias("term"))
    n_t = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(joint.select("term").distinct(), "term")
    n = texts.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)))).first()[0] or 1
    information = F.log2(F.lit(float(n)) / F.col("n_c"))
    # A term that touches a base span may not be one by itself in the line as it is.
    there = F.greatest("n_t", "n_ct")
    pmi = F.log2(F.lit(float(n)) * F.col("n_ct") / (F.col("n_c") * there))
    return (
        joint.join(own, "entity").join(written(n_t, "terms"), "term", "left").fillna(0, ["n_t"])
        .filter((information > 0) & (pmi >= DISCLOSURE * information) & (F.col("often") | (there == F.col("n_ct"))))
        .groupBy("entity").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    )


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, base, terms) for each row: arrays of spans (kind, start, end, value)."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = written(docs.select("id", F.xxhash64("text").alias("text_hash"), hit_lines(F.col("text")).alias("hits")), "base")
    every = F.flatten(F.transform("hits", lambda h: _shifted(h["spans"], h["start"])))
    of_kind = [F.filter(every, (lambda kind: lambda s: s["kind"] == kind)(k)) for k in KINDS]
    base = rows.select("id", "text_hash", F.concat(*of_kind).alias("base"))
    hits = rows.filter(F.size("hits") > 0).select("id", "text_hash", F.explode("hits").alias("h")).select("id", "text_hash", "h.*")
    lines = written(context_lines(hits.select("line", "spans")).withColumn("at", F.monotonically_increasing_id()), "lines")
    revealing = written(disclosing_terms(lines, docs.select("text")), "revealing")
    # Lines themselves are joined late: no row of an entity holds one.
    told = lines.select("at", F.explode("entities").alias("entity")).join(revealing, "entity")
    told = told.groupBy("at").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("told")).join(lines.select("at", "line", "masked"), "at")
    spans = F.filter(located(F.col("masked"), TERM, "term"), lambda s: F.array_contains("told", F.lower(s["value"])))
    of_line = written(told.select("line", spans.alias("spans")).filter(F.size("spans") > 0), "told")
    here = hits.select("id", "text_hash", "start", "line").distinct().join(of_line, "line")
    by_doc = here.groupBy("id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list(_shifted(F.col("spans"), F.col("start"))))).alias("terms"))
    left, right = base.alias("l"), by_doc.alias("r")
    joined = left.join(right, F.expr("l.id <=> r.id and l.text_hash = r.text_hash"), "left")
    own = F.coalesce("r.terms", F.array().cast(_SPAN))
    return joined.select(F.col("l.id").alias("id"), F.col("l.text_hash").alias("text_hash"), "l.base", own.alias("terms"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _label(span: Column, before: Column) -> Column:
    return F.when(span["start"] >= before, F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise(F.lit(""))


def replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column] = _label) -> Column:
    """text with its spans' code points replaced, by default by their kind in brackets.

    by(span, before) stands for a span where all up to before is replaced already; by default overlapping spans become one.
    """
    def parts(ordered: Column) -> Column:
        def of(ends: Column) -> Column:
            befores = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
            pieces = F.zip_with(ordered, befores, lambda s, before: F.concat(text.substr(before + 1, F.greatest(F.lit(0), s["start"] - before)), by(s, before)))
            return F.concat(F.array_join(pieces, ""), text.substr(F.element_at(ends, -1) + 1, F.length(text)))

        return _bound(_running(F.transform(ordered, lambda s: s["end"]), F.greatest), of)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    return F.when(F.size(spans) > 0, _bound(ordered, parts)).otherwise(text)


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, with base values removed and disclosing terms generalised in its texts.

    Rows without spans pass as they are; only the others are joined with their spans.
    """
    spans = found(df, id_col, text_col).select("id", "text_hash", F.concat("base", "terms").alias("spans"))
    spans = written(spans.filter(F.size("spans") > 0).distinct(), "spans")
    some = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumns({"__id": F.col(id_col), "__hash": F.xxhash64(some)})
    hit = _hinted(some)
    left, right = keyed.filter(hit).alias("l"), spans.alias("r")
    joined = left.join(right.hint("merge"), F.expr("l.__id <=> r.id and l.__hash = r.text_hash"), "left").select(
        *[F.col(f"l.{c}") if c != text_col else
          F.when(F.col("r.spans").isNotNull(), replaced(F.col(f"l.{text_col}"), F.col("r.spans"))).otherwise(F.col(f"l.{text_col}")).alias(text_col)
          for c in df.columns]
    )
    return df.filter(~hit).unionByName(joined)


def op5_pii(spark, sf_dir):
    rows = found(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_term"),
    )
