"""Seeded synthetic data as columns of hashes: the same rows for any partitioning."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRESETS = {"small": (1_000, 20_000), "medium": (10_000, 250_000), "large": (100_000, 1_000_000)}
FIRST = "ava noah mei rahul elodie omar lucia jonas amara kenji sofia ivan".split()
LAST = "adams brown zhang chaudhary mueller haddad garcia larsen okafor tanaka rossi petrov".split()
STREETS = "maple oak cedar hill lake park station mill".split()
CITIES = {"US": "springfield", "GB": "leeds", "SG": "kampong baru", "DE": "mainz", "IN": "pune", "AE": "sharjah"}
#: Edits of rows that are there, and episodes of rows that are put in: rows of an episode, and seconds over which it lies.
EDITS = ("large_amount", "odd_hour", "new_country", "round_amount", "structuring")
EPISODES = {"burst": (6, 600), "velocity": (12, 86_400), "repeated": (5, 10 * 86_400)}
ANOMALIES = (*EDITS, *EPISODES)
DISCREPANCIES = ("missing_ledger", "duplicate_posting", "amount_mismatch", "currency_mismatch", "reference_mismatch", "late_posting")
START = "2025-01-01"


def u(*parts) -> Column:
    """A uniform number in [0, 1) of a row's key and a label."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 40)) / float(1 << 40)


def pick(values, *parts) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(u(*parts) * len(values)).cast("int"))


def normal(*parts) -> Column:
    return F.sqrt(-2 * F.log(u(*parts, "a") + 1e-12)) * F.cos(2 * 3.141592653589793 * u(*parts, "b"))


def customers(spark: SparkSession, n: int, seed: int, duplicates: float = 0.02, namesakes: float = 0.01) -> DataFrame:
    """People; a share repeats an earlier person (same birth and address) or only an earlier name."""
    i = F.col("id")
    kind = u(i, seed, "kind")
    relation = F.when((i > 0) & (kind < duplicates), "duplicate_of").when((i > 0) & (kind < duplicates + namesakes), "namesake_of").otherwise("unique")
    rows = spark.range(n).withColumn("relation", relation).withColumn("of", F.when(F.col("relation") != "unique", F.floor(u(i, seed, "of") * i).cast("long")))
    who = F.coalesce("of", "id")
    person = F.when(F.col("relation") == "namesake_of", i).otherwise(who)
    country = pick(list(CITIES), person, seed, "country")
    city = F.element_at(F.create_map(*[F.lit(x) for p in CITIES.items() for x in p]), country)
    return rows.select(
        F.format_string("CUST-%07d", i).alias("customer_id"), F.initcap(F.concat_ws(" ", pick(FIRST, who, seed, "f"), pick(LAST, who, seed, "l"))).alias("name"),
        F.lit("").alias("alternate_names"), F.date_add(F.lit("1950-01-01").cast("date"), F.floor(u(person, seed, "b") * 18_000).cast("int")).alias("date_of_birth"),
        F.concat(F.floor(u(person, seed, "no") * 900 + 1).cast("string"), F.lit(" "), F.initcap(pick(STREETS, person, seed, "st")), F.lit(" Street, "), F.initcap(city), F.lit(", "), country).alias("address"),
        country.alias("country"), F.lit("clerk").alias("occupation"), pick(("personal", "business", "savings"), i, seed, "acc").alias("account_type"),
        F.lit("2020-01-01").cast("date").alias("account_open_date"), F.lit(1827).alias("account_age_days"),
        pick(("verified", "pending", "expired", "rejected"), i, seed, "kyc").alias("kyc_status"), F.lit(True).alias("is_synthetic"),
        "relation", F.when(F.col("of").isNotNull(), F.format_string("CUST-%07d", "of")).alias("related_customer_id"),
    )


VARIATIONS = ("none", "reordered", "initial", "typo", "address_short", "dob_swapped", "accent", "other_case")


def kyc_records(people: DataFrame, seed: int) -> DataFrame:
    """One document per person; `variation` names what was done to it, and is set only where it changed something."""
    k = F.col("customer_id")
    kind = pick(VARIATIONS, k, seed, "var")
    first, last = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    name = (
        F.when(kind == "reordered", F.concat_ws(", ", last, first)).when(kind == "initial", F.concat(F.left(first, F.lit(1)), F.lit(". "), last))
        .when(kind == "typo", F.concat(F.substring("name", F.lit(1), F.length("name") - 2), F.right("name", F.lit(1)))).when(kind == "accent", F.replace("name", F.lit("a"), F.lit("á")))
        .when(kind == "other_case", F.upper("name")).otherwise(F.col("name"))
    )
    born = F.col("date_of_birth")
    swapped = F.when((kind == "dob_swapped") & (F.day(born) <= 12), F.make_date(F.year(born), F.day(born), F.month(born))).otherwise(born)
    address = F.when(kind == "address_short", F.replace("address", F.lit("Street"), F.lit("St"))).otherwise(F.col("address"))
    changed = (name != F.col("name")) | (swapped != born) | (address != F.col("address"))
    return people.select(
        F.concat(F.lit("DOC-"), F.substring("customer_id", 6, 7)).alias("document_id"), "customer_id", name.alias("name"), swapped.alias("date_of_birth"), address.alias("address"),
        pick(("passport", "national_id", "drivers_license"), k, seed, "doc").alias("document_type"), F.upper(F.substring(F.md5(k), 1, 9)).alias("document_number"),
        F.lit("2022-01-01").cast("date").alias("issue_date"), F.lit("2032-01-01").cast("date").alias("expiry_date"), F.lit(True).alias("is_synthetic"),
        F.when(changed, kind).otherwise("none").alias("variation"),
    )


def quotas(n: int, share: float) -> dict[str, int]:
    """Rows of each kind of anomaly, round(share * n) in all; what does not divide goes to the first kind."""
    total = round(share * n)
    each = dict.fromkeys(ANOMALIES, total // len(ANOMALIES))
    each[ANOMALIES[0]] += total - sum(each.values())
    return each


def shuffled_place(i: Column, n: int, seed: int) -> Column:
    """The place of row i of n in a seeded order: a bijection, so that the first q places are exactly q rows, without a sort."""
    step = max(int(n * 0.6180339887) + seed % 97, 1)
    while gcd(step, n) != 1:
        step += 1
    return F.pmod(i * F.lit(step) + F.lit(seed * 7919), F.lit(n))


def transactions(spark: SparkSession, n: int, n_customers: int, seed: int, anomalies: float = 0.0175) -> DataFrame:
    """n lognormal amounts over half a year, of customers of uneven activity, anomalies injected in exact numbers.

    anomaly_type names what was done to a row; rows of an episode (put in, not edited) also have its episode_id.
    """
    quota = quotas(n, anomalies)
    base = n - sum(quota[k] for k in EPISODES)
    i, place = F.col("id"), shuffled_place(F.col("id"), base, seed)
    edited = _rows(spark.range(base), i, seed, n_customers, _edit(place, quota), F.lit(None).cast("string"), None)
    parts = [edited]
    for k, (size, seconds) in EPISODES.items():
        episode = F.floor(i / size).cast("long")
        begin = F.floor(u(episode, seed, k, "begin") * (180 * 86_400 - seconds)).cast("long")
        second = begin + F.floor((F.pmod(i, F.lit(size)) + u(i, seed, k, "in") * 0.9) * (seconds // size)).cast("long")
        who = F.floor(u(episode, seed, k, "who") * n_customers).cast("long")
        level = F.round(F.exp(5 + 0.5 * normal(episode, seed, k)), 0)
        amount = level if k == "repeated" else F.round(level * (1 + 0.2 * u(i, seed, k, "amount")), 2)
        parts.append(_rows(spark.range(quota[k]), i, seed, n_customers, F.lit(k), F.concat(F.lit(f"{k.upper()}-"), episode.cast("string")), (who, second, amount, episode)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edit(place: Column, quota: dict[str, int]) -> Column:
    """The edit of a row by its place: the first places, kind by kind, in their numbers."""
    kind, upto = F.when(F.lit(False), ""), 0
    for k in EDITS:
        upto += quota[k]
        kind = kind.when(place < upto, k)
    return kind.otherwise("none")


def _rows(ids: DataFrame, i: Column, seed: int, n_customers: int, kind: Column, episode_id: Column, given: tuple | None) -> DataFrame:
    """Transactions of ids; given: who, second, amount and episode of rows of an episode, whose receiver is one new counterparty."""
    who = given[0] if given else F.floor(F.pow(u(i, seed, "who"), F.lit(2.0)) * n_customers).cast("long")
    usual = F.round(F.exp(4 + 0.8 * normal(i, seed, "amount") + 0.5 * normal(who, seed, "level")), 2)
    amount = F.when(kind == "large_amount", usual * 40).when(kind == "structuring", 9_000 + F.round(u(i, seed, "s") * 900, 2)).when(kind == "round_amount", F.lit(5_000.0)).otherwise(F.greatest(usual, F.lit(0.01)))
    second = given[1] if given else F.floor(u(i, seed, "t") * 180 * 86_400).cast("long")
    second = F.when(kind == "odd_hour", second - second % 86_400 + 3 * 3600).otherwise(second)
    home = pick(list(CITIES), who, seed, "home")
    there = F.when(kind == "new_country", F.lit("PA")).otherwise(F.when(u(i, seed, "abroad") < 0.1, pick(list(CITIES), i, seed, "abroad2")).otherwise(home))
    key = F.concat(kind, i.cast("string")) if given else i
    number = F.concat(F.upper(F.left(kind, F.lit(1))), F.format_string("%08d", i)) if given else F.format_string("%09d", i)
    receiver = F.format_string("CP-N%s", F.concat(F.upper(F.left(kind, F.lit(1))), given[3].cast("string"))) if given else F.format_string("CP-%05d", F.floor(u(i, seed, "cp") * 500).cast("long"))
    rows = ids.select(
        F.concat(F.lit("TXN-"), number).alias("transaction_id"), F.format_string("CUST-%07d", who).alias("customer_id"),
        F.expr(f"timestamp_ntz'{START} 00:00:00'").alias("start"), second.alias("second"), (given[2] if given else amount).cast("double").alias("amount"), F.lit("USD").alias("currency"),
        F.lit("transfer_out").alias("transaction_type") if given else pick(("transfer_out", "transfer_in", "payment", "withdrawal", "deposit"), i, seed, "type").alias("transaction_type"),
        F.format_string("CUST-%07d", who).alias("sender"), receiver.alias("receiver"), home.alias("sender_country"), there.alias("receiver_country"),
        pick(("mobile", "web", "branch", "atm", "pos"), key, seed, "ch").alias("channel"),
        F.when(u(key, seed, "ref") < 0.9, F.concat(F.lit("REF-"), number)).alias("reference_id"), F.lit(True).alias("is_synthetic"), kind.alias("anomaly_type"), episode_id.alias("episode_id"),
    )
    return rows.withColumn("timestamp", F.col("start") + F.make_dt_interval(secs=F.col("second"))).drop("start", "second")


def ledger(tx: DataFrame, seed: int, share: float = 0.015) -> DataFrame:
    """Postings; `discrepancy` names what was done to a transaction's. Duplicates are extra rows, missing ones no row."""
    k = F.col("transaction_id")
    kind = F.when(u(k, seed, "d") < share, pick(DISCREPANCIES, k, seed, "dk")).otherwise("none")
    kind = F.when((kind == "reference_mismatch") & F.col("reference_id").isNull(), "none").otherwise(kind)
    rows = tx.withColumn("discrepancy", kind).filter("discrepancy <> 'missing_ledger'")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("discrepancy") == "duplicate_posting", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    late = F.when(F.col("discrepancy") == "late_posting", 5 * 86_400).otherwise(1800)
    return rows.select(
        F.concat(F.lit("LED-"), F.substring("transaction_id", 5, 9), F.lit("-"), F.col("copy").cast("string")).alias("ledger_id"), "transaction_id",
        F.when(F.col("discrepancy") == "amount_mismatch", F.col("amount") * 1.2 + 1).otherwise(F.col("amount")).alias("posted_amount"),
        F.when(F.col("discrepancy") == "currency_mismatch", "EUR").otherwise(F.col("currency")).alias("currency"),
        (F.col("timestamp") + F.make_dt_interval(secs=late + F.col("copy") * 60)).alias("posting_timestamp"), F.lit("settled").alias("settlement_status"),
        F.when(F.col("discrepancy") == "reference_mismatch", F.lit("REF-OTHER")).otherwise(F.col("reference_id")).alias("reference_id"), F.lit(True).alias("is_synthetic"), "discrepancy",
    )


def exact_quota(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """df with `chosen` for exactly n rows, those of least hash: Spark takes the n least of each task first."""
    least = df.select(key, F.xxhash64(key, F.lit(seed)).alias("h")).orderBy("h", key).limit(n).select(key, F.lit(True).alias("chosen"))
    return df.join(least, key, "left").fillna(False, ["chosen"])


def problems(people: DataFrame, documents: DataFrame, tx: DataFrame, posted: DataFrame) -> DataFrame:
    """(problem, n) of a generated set: repeated keys, orphans, bad amounts."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")

    parts = [
        count(people.groupBy("customer_id").count().filter("count > 1"), "repeated customer_id"), count(tx.groupBy("transaction_id").count().filter("count > 1"), "repeated transaction_id"),
        count(posted.groupBy("ledger_id").count().filter("count > 1"), "repeated ledger_id"), count(documents.join(people, "customer_id", "left_anti"), "document without customer"),
        count(tx.join(people, "customer_id", "left_anti"), "transaction without customer"), count(posted.join(tx, "transaction_id", "left_anti"), "posting without transaction"),
        count(tx.filter("amount <= 0"), "amount not above 0"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
