"""Claim verification against evidence, the decision floor, policy flags and the critique, over all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.injection import pattern_flags
from ..functions.payload import payload_content
from ..functions.scalar import rank_of

DECISIONS = ("CLEAR", "REVIEW", "ESCALATE")
SEVERITIES = ("low", "medium", "high")
STATUS_RULES = ("REC-009", "REC-010")
# The currencies that count, and the months' names.
CURRENCIES = ("USD", "GBP", "EUR", "INR", "AED", "SGD", "CAD", "AUD")
MONTHS = "january february march april may june july august september october november december".split()


def _month() -> str:
    """Names and short names, all lower, capitalised or all upper; "may" in lower case is a verb."""
    names = {n for m in MONTHS for n in (m, m[:3])} | {"sept"}
    forms = {f for n in names for f in (n, n.capitalize(), n.upper()) if f != "may"}
    return "(?:" + "|".join(sorted(forms, key=lambda f: (-len(f), f))) + ")"


_DAY, _YEAR, _NOON = r"\d{1,2}(?:st|nd|rd|th)?", r"(?:,?\s+\d{4})?\b", r"(?i:am|pm|a\.m\.|p\.m\.)(?![A-Za-z])"
_MDY = rf"{_month()}\.?\s+{_DAY}{_YEAR}"
#: One pass over a text finds all that can be checked: at each place the first form that fits. A citation's E: or K:
#: belongs to its id; a chunk's id is document:section:number. Digits that touch letters, hyphens or colons are no number.
LEXER = "|".join((
    r"\b(?:[EK]:)?(?:KB-[A-Z]+-\d+(?::[a-z0-9-]+)*|[A-Z]{2,}(?:-[A-Za-z0-9]+)+)\b", r"\b[a-z_][a-z0-9_]*:[a-z0-9_-]+:\d+\b",
    r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2})?", rf"\b{_MDY}", rf"\b{_DAY}\s+(?!{_MDY}){_month()}\.?{_YEAR}",
    rf"\b\d{{1,2}}:\d{{2}}\s?{_NOON}", r"\b\d{1,2}:\d{2}\b", rf"\b\d{{1,2}}\s?{_NOON}",
    r"(?<![\w.:-])\d[\d,]*(?:\.\d+)?(?![\w:-])", r"\b(?:" + "|".join(CURRENCIES) + r")\b",
))
#: What a found piece is: the first that its beginning, or all of it, fits; else it is a number.
_SORTS = (
    ("id", r"^[EK]:|^[A-Z]{2,}-|^[a-z_][a-z0-9_]*:"), ("date", r"^\d{4}-\d{2}-\d{2}"), ("currency", r"^[A-Z]{3}$"), ("spoken", r"^[A-Za-z]"),
    ("noon", r"(?i)^\d{1,2}\s?[ap]\.?m\.?$"), ("clock", ":"), ("spoken", "[A-Za-z]"),
)


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def citation(ref: Column) -> Column:
    """A reference without the E: or K: that a citation may begin with."""
    return F.when(F.substring(ref, 1, 2).isin("E:", "K:"), F.substring(ref, F.lit(3), F.length(ref))).otherwise(ref)


def tokens(text: Column) -> Column:
    """struct of the checkable content of a text: ids, dates, month_days, times, hours, numbers (text), currencies."""
    def sort(piece: Column) -> Column:
        kind = F.lit("number")
        for name, pattern in reversed(_SORTS):
            kind = F.when(piece.rlike(pattern), name).otherwise(kind)
        return F.struct(kind.alias("kind"), piece.alias("piece"))

    return _bound(F.transform(F.regexp_extract_all(text, F.lit(LEXER), F.lit(0)), sort), _content)


def _content(found: Column) -> Column:
    def of(*kinds: str) -> Column:
        return F.transform(F.filter(found, lambda x: x["kind"].isin(*kinds)), lambda x: x["piece"])

    months = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m[:3]), F.lit(f"{i + 1:02d}"))])

    def spoken(x: Column) -> Column:
        """yyyy-mm-dd, or mm-dd without a year."""
        month = F.element_at(months, F.lower(F.substring(F.regexp_extract(x, f"({_month()})", 1), 1, 3)))
        day = F.lpad(F.regexp_extract(x, r"(?<!\d)(\d{1,2})(?!\d)", 1), 2, "0")
        year = F.regexp_extract(x, r"(\d{4})$", 1)
        return F.when(year != "", F.concat_ws("-", year, month, day)).otherwise(F.concat_ws("-", month, day))

    def clock(x: Column) -> Column:
        hour = F.regexp_extract(x, r"^(\d{1,2})", 1).cast("int")
        pm = F.when(x.rlike("(?i)p"), 12).otherwise(0)
        hour = F.when(x.rlike("(?i)[ap]"), hour % 12 + pm).otherwise(hour % 24)
        return F.struct(hour.alias("hour"), F.regexp_extract(x, r":(\d{2})", 1).alias("minute"))

    stamped = F.transform(F.filter(of("date"), lambda d: F.length(d) > 10), lambda d: F.substring(d, 12, 5))
    parts = F.struct(
        F.transform(of("spoken"), spoken).alias("days"), F.transform(F.concat(stamped, of("clock")), clock).alias("clocks"),
        F.transform(of("noon"), lambda x: clock(x)["hour"]).alias("noons"),
    )
    return _bound(parts, lambda p: F.struct(
        F.array_distinct(F.transform(of("id"), citation)).alias("ids"),
        F.array_distinct(F.concat(F.transform(of("date"), lambda d: F.substring(d, 1, 10)), F.filter(p["days"], lambda d: F.length(d) == 10))).alias("dates"),
        F.array_distinct(F.filter(p["days"], lambda d: F.length(d) == 5)).alias("month_days"),
        F.array_distinct(F.transform(p["clocks"], lambda c: F.format_string("%02d:%s", c["hour"], c["minute"]))).alias("times"),
        F.array_distinct(F.concat(F.transform(p["clocks"], lambda c: c["hour"]), p["noons"])).alias("hours"),
        F.transform(of("number"), lambda n: F.replace(n, F.lit(","), F.lit(""))).alias("numbers"),
        F.array_distinct(of("currency")).alias("currencies"),
    ))


KINDS = ("ids", "dates", "month_days", "times", "hours", "numbers", "currencies")


#: Stands between texts that are read together and fits no form.
_APART = "\x1f"


def evidence_index(evidence: DataFrame) -> DataFrame:
    """One row per evidence item (case_id, ref, kind, text) with its tokens.

    Its own reference counts as an id in it. With a column `payload` (JSON text)
    all its values count too, at any depth: numbers as they are, strings by what
    they hold, field names as words, and a whole `hour_of_day` as an hour.
    """
    own = lambda t, ref: t.withField("ids", F.array_union(t["ids"], F.array(ref)))
    if "payload" not in evidence.columns:
        return evidence.select("case_id", "ref", "kind", _bound(tokens(F.col("text")), lambda t: own(t, F.col("ref"))).alias("t"))
    rows = evidence.select("case_id", "ref", "kind", "text", payload_content(F.col("payload")).alias("p"))
    words = F.concat_ws(_APART, F.col("text"), F.array_join("p.strings", _APART), F.array_join("p.fields", _APART))

    def joined(t: Column) -> Column:
        hours = F.when(F.col("p.hour").isNotNull(), F.array_union(t["hours"], F.array("p.hour"))).otherwise(t["hours"])
        return own(t, F.col("ref")).withField("numbers", F.concat(t["numbers"], F.col("p.numbers"))).withField("hours", hours)

    return rows.select("case_id", "ref", "kind", _bound(tokens(words), joined).alias("t"))


def supported(number: Column, available: Column) -> Column:
    """Whether some number is within half a unit of the last decimal that is written."""
    places = F.length(F.regexp_extract(number, r"\.(\d+)$", 1))
    reach = 0.5 * F.pow(F.lit(10.0), -places) + 1e-9
    return F.exists(available, lambda a: F.abs(a.cast("double") - number.cast("double")) <= reach)


def missing(mine: Column, have: Column) -> Column:
    """struct of what `mine` says and `have` (a struct of arrays) does not."""
    known_days = F.concat(have["month_days"], F.transform(have["dates"], lambda d: F.substring(d, 6, 5)))
    plain = {k: F.array_except(mine[k], have[k]) for k in ("ids", "dates", "times", "hours", "currencies")}
    plain["month_days"] = F.array_except(mine["month_days"], known_days)
    plain["numbers"] = F.filter(mine["numbers"], lambda n: ~supported(n, have["numbers"]))
    return F.struct(*[plain[k].alias(k) for k in KINDS])


def any_of(sets: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    return sum((F.size(sets[k]) for k in kinds), F.lit(0)) > 0


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.struct(*[F.flatten(F.collect_list(f"t.{k}")).alias(k) for k in KINDS]).alias("have"))


def verdicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (case_id, claim_id, claim, claim_kind, refs) with status and the sets that are missing.

    In order: an unknown reference, a fact without case evidence, no evidence:
    unsupported; nothing to check: unverifiable; all found: supported; an
    inference that lacks only derived values: unverifiable; else unsupported.
    """
    index = evidence_index(evidence)
    cited = claims.select("case_id", "claim_id", F.explode(F.array_distinct(F.transform("refs", citation))).alias("ref")).join(index, ["case_id", "ref"], "left")
    known = cited.groupBy("case_id", "claim_id").agg(
        F.count_if(F.col("kind").isNull()).alias("unknown"), F.count_if(F.col("kind") == "evidence").alias("case_items"), F.count("kind").alias("items"))
    have = _gathered(cited.filter("kind is not null"), "case_id", "claim_id")
    empty = F.from_json(F.lit("{" + ",".join(f'"{k}":[]' for k in KINDS) + "}"), index.schema["t"].dataType.simpleString())
    rows = claims.join(known, ["case_id", "claim_id"], "left").join(have, ["case_id", "claim_id"], "left").withColumn("mine", tokens(F.col("claim")))
    rows = rows.fillna(0, ["unknown", "case_items", "items"]).withColumn("have", F.coalesce("have", empty)).withColumn("missing", missing(F.col("mine"), F.col("have")))
    status = (
        F.when(F.col("unknown") > 0, "unsupported").when((F.col("claim_kind") == "fact") & (F.col("case_items") == 0), "unsupported")
        .when(F.col("items") == 0, "unsupported").when(~any_of(F.col("mine")), "unverifiable").when(~any_of(F.col("missing")), "supported")
        .when((F.col("claim_kind") == "inference") & ~any_of(F.col("missing"), ("ids", "dates", "currencies")), "unverifiable").otherwise("unsupported")
    )
    return rows.withColumn("status", status).drop("have", "mine")


def grounded(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """texts (case_id, text) with `grounded`: all that can be checked is in some evidence of the case."""
    have = _gathered(evidence_index(evidence.filter("kind = 'evidence'")), "case_id")
    rows = texts.withColumn("mine", tokens(F.col("text"))).join(have, "case_id", "left")
    lacking = F.coalesce(any_of(missing(F.col("mine"), F.col("have"))), any_of(F.col("mine")))
    return rows.withColumn("grounded", ~lacking).drop("mine", "have")


def floor_reasons(e: dict[str, Column], least: str = "medium", status_rules: bool = False) -> Column:
    """Why one evidence item calls for review, as an array. e: columns by name; absent facts are null."""
    serious = rank_of(e["severity"], SEVERITIES) >= SEVERITIES.index(least) + 1
    counted = F.lit(True) if status_rules else ~e["rule_id"].isin(*STATUS_RULES)
    reasons = [
        F.when(e["rule_id"].isNotNull() & counted & serious, F.concat_ws(" ", F.lit("reconciliation"), e["rule_id"], e["severity"])),
        F.when(e["flagged"], F.lit("anomaly model flagged the transaction")),
        F.when(e["other_strong"] > 0, F.lit("other strong candidate records")),
        F.when(e["is_match"] & ~F.coalesce(e["own_rank"] == 1, F.lit(False)), F.lit("own record is not the best match")),
        F.when(e["birth_conflict"], F.lit("date-of-birth conflict")),
        F.when(e["new_cross_border"], F.lit("new cross-border counterparty")),
        F.when(e["structuring"], F.lit("possible structuring")),
        F.when(F.size(pattern_flags(e["text"])) > 0, F.lit("instruction-like text in evidence")),
    ]
    return F.array_compact(F.array(*reasons))


FACTS = {"rule_id": "string", "severity": "string", "flagged": "boolean", "other_strong": "int", "is_match": "boolean", "own_rank": "int",
         "birth_conflict": "boolean", "new_cross_border": "boolean", "structuring": "boolean", "text": "string"}


def engine_floor(evidence: DataFrame, **options) -> DataFrame:
    """(case_id, floor, reasons): REVIEW if any item of the case calls for it, else null; never higher. Text within a column `payload` (JSON) is read too."""
    columns = {k: F.col(k) if k in evidence.columns else F.lit(None).cast(t) for k, t in FACTS.items()}
    if "payload" in evidence.columns:
        columns["text"] = F.concat_ws("\n", columns["text"], payload_content(F.col("payload"))["strings"])
    rows = evidence.select("case_id", floor_reasons(columns, **options).alias("r"))
    return rows.groupBy("case_id").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("reasons")).withColumn(
        "floor", F.when(F.size("reasons") > 0, F.lit("REVIEW"))
    )


def policy_flags(action: Column, floor: Column, unsupported: Column, supported_: Column, is_grounded: Column, confidence: Column, suspicious: Column, text: Column, ceiling: float = 0.7) -> Column:
    """The policy flags of a case in order; the first four are violations."""
    clear = action == "CLEAR"
    return F.array_compact(F.array(
        F.when(clear & floor.isNotNull(), "CLEAR_BELOW_ENGINE_FLOOR"), F.when(clear & (unsupported > 0), "CLEAR_WITH_UNSUPPORTED_CLAIMS"),
        F.when(clear & (supported_ == 0), "CLEAR_WITHOUT_SUPPORTED_EVIDENCE"), F.when(~is_grounded, "SUMMARY_NOT_GROUNDED"),
        F.when((unsupported > 0) & (confidence > ceiling), "HIGH_CONFIDENCE_WITH_UNSUPPORTED_CLAIMS"), F.when(suspicious, "SUSPICIOUS_EVIDENCE_TEXT"),
        F.when(F.size(pattern_flags(text)) > 0, "OUTPUT_CONTAINS_INSTRUCTION_LIKE_TEXT"),
    ))


VIOLATIONS = ("CLEAR_BELOW_ENGINE_FLOOR", "CLEAR_WITH_UNSUPPORTED_CLAIMS", "CLEAR_WITHOUT_SUPPORTED_EVIDENCE", "SUMMARY_NOT_GROUNDED")


def decided(model: Column, floor: Column, unsupported: Column) -> Column:
    """The highest of the model's decision, the floor, and REVIEW where claims are unsupported."""
    place = F.greatest(rank_of(model, DECISIONS), rank_of(floor, DECISIONS), F.when(unsupported > 0, 2))
    return F.get(F.array(*map(F.lit, DECISIONS)), place - 1)


def critique(cases: DataFrame) -> DataFrame:
    """cases (model_decision, floor, n_unsupported, n_supported, grounded, confidence, suspicious, text) with decision, flags, validated, raised."""
    flags = policy_flags(*[F.col(c) for c in ("model_decision", "floor", "n_unsupported", "n_supported", "grounded", "confidence", "suspicious", "text")])
    rows = cases.withColumns({"flags": flags, "decision": decided(F.col("model_decision"), F.col("floor"), F.col("n_unsupported"))})
    broken = F.exists("flags", lambda f: f.isin(*VIOLATIONS))
    return rows.withColumns({
        "validated": F.col("model_decision").isNotNull() & (F.col("n_unsupported") == 0) & F.col("grounded") & ~broken,
        "raised": ~F.col("decision").eqNullSafe(F.col("model_decision")) & F.col("decision").isNotNull(),
    })


def ablations(cases: DataFrame) -> DataFrame:
    """Three decisions per case: the model alone, with the floor, and in full."""
    none = F.lit(0)
    return cases.withColumns({
        "model_only": F.col("model_decision"), "with_floor": decided(F.col("model_decision"), F.col("floor"), none),
        "full": decided(F.col("model_decision"), F.col("floor"), F.col("n_unsupported")),
    })


#: The ablation's configurations (fixed): engines that count, least severity, whether settlement-status rules count.
CONFIGURATIONS = (
    ("full", ("recon", "anomaly", "kyc"), "medium", False), ("recon", ("recon",), "medium", False), ("anomaly", ("anomaly",), "medium", False),
    ("kyc", ("kyc",), "medium", False), ("recon_anomaly", ("recon", "anomaly"), "medium", False), ("recon_kyc", ("recon", "kyc"), "medium", False),
    ("anomaly_kyc", ("anomaly", "kyc"), "medium", False), ("low_severity", ("recon", "anomaly", "kyc"), "low", False),
    ("high_severity", ("recon", "anomaly", "kyc"), "high", False), ("status_rules", ("recon", "anomaly", "kyc"), "medium", True),
)
#: Evidence ids of an engine begin so.
ENGINE_PREFIXES = {"recon": "REC-", "anomaly": "ANOM-", "kyc": "KYCM-"}


def of_engines(evidence: DataFrame, engines: tuple[str, ...]) -> DataFrame:
    """Evidence of these engines, and what no engine made, by the prefix of evidence_id."""
    off = [p for e, p in ENGINE_PREFIXES.items() if e not in engines]
    kept = F.lit(True)
    for p in off:
        kept = kept & ~F.col("evidence_id").startswith(p)
    return evidence.filter(kept)


def component_ablation(evidence: DataFrame) -> DataFrame:
    """(configuration, case_id, flagged) for every case of evidence and every configuration.

    One pass: each item's reasons under every configuration, as an array, or-ed
    by case; no copy of the evidence a configuration.
    """
    columns = {k: F.col(k) if k in evidence.columns else F.lit(None).cast(t) for k, t in FACTS.items()}

    def counts(engines: tuple[str, ...], least: str, status_rules: bool) -> Column:
        kept = F.lit(True)
        for e, p in ENGINE_PREFIXES.items():
            if e not in engines:
                kept = kept & ~F.col("evidence_id").startswith(p)
        return F.coalesce(kept, F.lit(True)) & (F.size(floor_reasons(columns, least, status_rules)) > 0)

    flags = evidence.select("case_id", *[counts(*c).alias(name) for name, *c in CONFIGURATIONS])
    by_case = flags.groupBy("case_id").agg(*[F.max(name).alias(name) for name, *_ in CONFIGURATIONS])
    each = F.array(*[F.struct(F.lit(name).alias("configuration"), F.col(name).alias("flagged")) for name, *_ in CONFIGURATIONS])
    return by_case.select("case_id", F.explode(each).alias("x")).select("x.configuration", "case_id", "x.flagged")


def ablation_rates(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Per configuration: recall by kind of problem, false flags of clean cases, precision. truth: (case_id, category)."""
    rows = flags.join(truth, "case_id")
    hit = F.col("flagged").cast("double")
    return rows.groupBy("configuration").agg(
        F.avg(F.when(F.col("category") == "reconciliation", hit)).alias("recall_reconciliation"), F.avg(F.when(F.col("category") == "behavioural", hit)).alias("recall_behavioural"),
        F.avg(F.when(F.col("category") == "clean", hit)).alias("false_flags"), F.avg(F.when(F.col("flagged"), (F.col("category") != "clean").cast("double"))).alias("precision"),
    )


def elsewhere(judged: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, claim_id, elsewhere): for unsupported claims, the items of the case that hold all that is missing and that the claim does not cite."""
    index = evidence_index(evidence.filter("kind = 'evidence'")).select("case_id", "ref", F.col("t").alias("have"))
    lacking = judged.filter("status = 'unsupported'").select("case_id", "claim_id", "claim", "refs").withColumn("mine", tokens(F.col("claim")))
    rows = lacking.filter(any_of(F.col("mine"))).join(index, "case_id").filter(~F.array_contains("refs", F.col("ref")) & ~any_of(missing(F.col("mine"), F.col("have"))))
    return rows.groupBy("case_id", "claim_id").agg(F.array_sort(F.collect_set("ref")).alias("elsewhere"))


def verdict_counts(judged: DataFrame, *keys: str) -> DataFrame:
    """How many claims have each status."""
    return judged.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("supported", "unsupported", "unverifiable")])


def perturbed_citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (refs) that cite nothing, an unknown item, or an item of another kind of the case: change, claim, refs."""
    kind = lambda ref: F.regexp_extract(ref, r"^([A-Za-z]+)", 1)
    own = claims.select("case_id", "claim_id", kind(F.element_at("refs", 1)).alias("own"))
    others = own.join(evidence.select("case_id", "ref", kind(F.col("ref")).alias("other")), "case_id").filter("own <> other")
    wrong = others.groupBy("case_id", "claim_id").agg(F.min("ref").alias("wrong"))
    rows = claims.join(wrong, ["case_id", "claim_id"], "left")
    none = F.array().cast("array<string>")
    forms = F.array(
        F.struct(F.lit("no_citation").alias("change"), none.alias("refs")), F.struct(F.lit("unknown_evidence").alias("change"), F.array(F.lit("GHOST-1")).alias("refs")),
        F.when(F.col("wrong").isNotNull(), F.struct(F.lit("wrong_citation").alias("change"), F.array("wrong").alias("refs"))),
    )
    each = rows.withColumn("x", F.explode(F.array_compact(forms)))
    return each.withColumn("refs", F.col("x.refs")).withColumn("change", F.col("x.change")).drop("x", "wrong")


def perturbed(claims: DataFrame) -> DataFrame:
    """Each claim in changed forms (change, claim), for measuring what the verdicts catch; see perturbed_citations for its references."""
    c = F.col("claim")
    number = F.regexp_extract(c, r"(\d+)", 1)
    forms = {
        "number_plus_one": F.when(number != "", F.regexp_replace(c, F.lit(r"\d+"), (number.try_cast("bigint") + 1).cast("string"))),
        "other_currency": F.when(c.rlike(r"\bUSD\b"), F.regexp_replace(c, r"\bUSD\b", "EUR")),
        "later_date": F.when(c.rlike(r"\d{4}-\d{2}-\d{2}"), F.regexp_replace(c, r"(\d{4}-\d{2})-\d{2}", "$1-28")),
        "other_id": F.when(c.rlike(r"\b[A-Z]{2,6}-\d"), F.regexp_replace(c, r"\b([A-Z]{2,6})-\d", "$1-9")),
        "added_id": F.concat(c, F.lit(" (see TXN-000000)")),
    }
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("change"), v.alias("text")) for k, v in forms.items()]), lambda x: x["text"].isNotNull() & (x["text"] != c))
    return claims.withColumn("x", F.explode(each)).withColumn("change", F.col("x.change")).withColumn("claim", F.col("x.text")).drop("x")
