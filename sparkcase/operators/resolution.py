"""Entity resolution: exact, fuzzy, BM25, dense, hybrid, structured and learned systems.

entries: (customer_id, name, birth, address struct) with one row an alias; queries: (query_id, name, birth, address struct).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import band
from ..functions.similarity import jaro_winkler_block, jaro_winkler_udf, token_set_udf, token_sort_ratio
from ..functions.text import name_parts, trigrams, words
from ..session import written
from . import retrieval

ALPHA, FIRST_STAGE, TOP = 0.5, 20, 5
BIRTH_WEIGHT, ADDRESS_WEIGHT = 0.6, 0.4
#: Names of either side that meet at once, about, and such blocks of one task.
LEFT_NAMES, RIGHT_NAMES, TASK_BLOCKS = 512, 2_048, 8
ADDRESS_WEIGHTS = {"number": 0.25, "street": 0.25, "city": 0.30, "country": 0.20}


def exact(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, customer_id): equal name or alias and equal birth date; nothing without a birth date."""
    return queries.join(entries, ["name", "birth"]).select("query_id", "customer_id").distinct()


def lexical(queries: DataFrame, entries: DataFrame, by: str = "words") -> DataFrame:
    """(query_id, customer_id, score): normalised BM25 over words or trigrams, best alias."""
    tokens = (words if by == "words" else trigrams)(F.col("name"))
    docs = entries.select(F.struct("customer_id", "name").alias("doc_id"), tokens.alias("tokens")).distinct()
    asks = queries.select("query_id", tokens.alias("tokens"))
    scored = retrieval.normalised(retrieval.bm25(asks, docs), retrieval.ceilings(asks, docs))
    return scored.groupBy("query_id", F.col("doc_id.customer_id").alias("customer_id")).agg(F.max("bm25_share").alias("score"))


def candidates_by_trigram(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, customer_id, q_name, name): pairs that share a trigram: plain blocking, for pairs to describe; fuzzyjoin loses no match."""
    left = queries.select("query_id", F.col("name").alias("q_name"), F.explode(F.array_distinct(trigrams(F.col("name")))).alias("gram"))
    right = entries.select("customer_id", "name", F.explode(F.array_distinct(trigrams(F.col("name")))).alias("gram"))
    return left.join(right, "gram").select("query_id", "customer_id", "q_name", "name").distinct()


def fuzzy(pairs: DataFrame) -> DataFrame:
    """(query_id, customer_id, score): best token-sort ratio of the aliases of given pairs; fuzzyjoin finds all pairs from a threshold on."""
    scored = pairs.withColumn("score", token_sort_ratio(F.col("q_name"), F.col("name")))
    return scored.groupBy("query_id", "customer_id").agg(F.max("score").alias("score"))


def jaro_winkler_within(left: DataFrame, right: DataFrame, left_names: int = LEFT_NAMES, right_names: int = RIGHT_NAMES) -> DataFrame:
    """(left_id, right_id, score): Jaro-Winkler of every row (left_id, name, key) with every row (right_id, name, key) of its key; rows without a name meet nothing.

    The rows of a key meet in blocks of bounded size, so neither its number of rows
    nor how few keys there are bounds how far the work is spread.
    """
    left, right = (df.filter("name IS NOT NULL") for df in (left, right))
    many = lambda df, c, size: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(c))
    sizes = written(many(left, "parts_l", left_names).join(many(right, "parts_r", right_names), "key"), "sizes")
    blocks = sizes.agg(F.sum(F.col("parts_l").cast("long") * F.col("parts_r"))).first()[0] or 0
    tasks = max(-(-blocks // TASK_BLOCKS), min(blocks, left.sparkSession.sparkContext.defaultParallelism), 1)

    def dealt(df: DataFrame, own: str, other: str, id_col: str) -> DataFrame:
        there = df.join(F.broadcast(sizes) if blocks < 100_000 else sizes, "key")
        part = F.pmod(F.xxhash64(id_col, "name"), F.col(f"parts_{own}")).cast("int").alias(own)
        rows = there.select("key", id_col, "name", part, F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1)).alias(other))
        return rows.repartition(tasks, "key", "l", "r").groupBy("key", "l", "r")

    schema = T.StructType([T.StructField("left_id", left.schema["left_id"].dataType), T.StructField("right_id", right.schema["right_id"].dataType), T.StructField("score", T.DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (t["name"].combine_chunks().dictionary_encode() for t in (a, b))
        scores = jaro_winkler_block(x.dictionary.to_pylist(), y.dictionary.to_pylist())[np.ix_(x.indices.to_numpy(), y.indices.to_numpy())]
        of_a, of_b = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        return pa.table({"left_id": a["left_id"].take(pa.array(of_a)), "right_id": b["right_id"].take(pa.array(of_b)), "score": scores.ravel()})

    return dealt(left, "l", "r", "left_id").cogroup(dealt(right, "r", "l", "right_id")).applyInArrow(run, schema)


def hybrid(first: DataFrame, second: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """alpha * first + (1 - alpha) * second, each already the best of a customer's aliases; a missing score is 0."""
    a = first.withColumnRenamed("score", "a")
    b = second.withColumnRenamed("score", "b")
    both = a.join(b, ["query_id", "customer_id"], "full").fillna(0.0, ["a", "b"])
    return both.select("query_id", "customer_id", (alpha * F.col("a") + (1 - alpha) * F.col("b")).alias("score"))


def top(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc(score), "customer_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def birth_score(a: Column, b: Column) -> tuple[Column, Column]:
    """(score, reason): 1 if equal, 0.5 with day and month swapped, else 0; null where either is missing."""
    swapped = (F.year(a) == F.year(b)) & (F.month(a) == F.day(b)) & (F.day(a) == F.month(b))
    score = F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when(swapped, 0.5).otherwise(0.0)
    reason = F.when(a.isNull() | b.isNull(), None).when(a == b, "dob_match").when(swapped, "dob_day_month_swapped").otherwise("dob_mismatch")
    return score, reason


def address_score(a: Column, b: Column) -> Column:
    """Weighted equality of the parts; null where either is missing or not in parts."""
    total = sum((F.when(a[k] == b[k], w).otherwise(0.0) for k, w in ADDRESS_WEIGHTS.items()), F.lit(0.0))
    return F.when(a["parsed"] & b["parsed"], total)


def structured_score(birth: Column, address: Column) -> Column:
    """Weighted mean of the parts that are there; 0 without any."""
    weight = F.when(birth.isNotNull(), BIRTH_WEIGHT).otherwise(0.0) + F.when(address.isNotNull(), ADDRESS_WEIGHT).otherwise(0.0)
    total = F.coalesce(birth * BIRTH_WEIGHT, F.lit(0.0)) + F.coalesce(address * ADDRESS_WEIGHT, F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def verified(candidates: DataFrame, queries: DataFrame, customers: DataFrame) -> DataFrame:
    """Candidates with structured evidence and the final score, half name and half structure."""
    q = queries.select("query_id", F.col("birth").alias("q_birth"), F.col("address").alias("q_address"))
    rows = candidates.join(q, "query_id").join(customers.select("customer_id", "birth", "address"), "customer_id")
    birth, reason = birth_score(F.col("q_birth"), F.col("birth"))
    rows = rows.withColumns({"birth_score": birth, "birth_reason": reason, "address_score": address_score(F.col("q_address"), F.col("address"))})
    final = 0.5 * F.col("score") + 0.5 * structured_score(F.col("birth_score"), F.col("address_score"))
    return rows.withColumn("final", final).withColumn("band", band(F.col("final"))).drop("q_birth", "q_address", "birth", "address")


def explained(rows: DataFrame) -> DataFrame:
    """rows (q_name, name, alias flag, fuzzy, q_reordered, q_initials) with reasons: the first that holds, then order and initials."""
    how = (
        F.when((F.col("q_name") == F.col("name")) & ~F.col("is_alias"), "name_exact").when(F.col("q_name") == F.col("name"), "alternate_name")
        .when(F.col("fuzzy") >= 0.85, "close_spelling").when(F.col("fuzzy") < 0.5, "low_similarity")
    )
    return rows.withColumn("reasons", F.array_compact(F.array(how, F.when(F.col("q_reordered"), "reordered"), F.when(F.col("q_initials"), "initials"))))


#: First-stage signals of a pair, besides its rank in the hybrid list.
SIGNALS = ["bm25", "bm25_char", "dense", "fuzzy", "hybrid"]


def _near(x: Column, y: Column) -> Column:
    """1 if equal, or one is the other's initial."""
    short = (F.length(x) == 1) | (F.length(y) == 1)
    return F.when((x == y) | (short & (F.left(x, F.lit(1)) == F.left(y, F.lit(1)))), 1.0).otherwise(0.0)


def pair_features(pairs: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """The 17 features of (query, customer) pairs, the name's structure from the alias nearest by Jaro-Winkler.

    pairs: (query_id, customer_id, q_name, name), a row an alias. signals:
    (query_id, customer_id, rank and SIGNALS); what is not there is 0.
    """
    pairs = pairs.withColumns({"q": name_parts(F.col("q_name")), "a": name_parts(F.col("name"))})
    near = pairs.withColumn("jw_full", jaro_winkler_udf("q.canonical", "a.canonical"))
    best = near.groupBy("query_id", "customer_id", "q_name").agg(
        F.max_by(F.struct("name", "a", "q"), F.struct("jw_full", "name")).alias("x"), F.max("jw_full").alias("jw_full"))
    best = best.select("query_id", "customer_id", "q_name", F.col("x.name").alias("alias"), "jw_full", "x.q", "x.a")
    middle = F.when((F.size("q.middle") == 0) | (F.size("a.middle") == 0), 1.0).otherwise(_near(F.get("q.middle", F.lit(0)), F.get("a.middle", F.lit(0))))
    rows = best.withColumns({
        "jw_first": jaro_winkler_udf("q.first", "a.first"), "jw_last": jaro_winkler_udf("q.last", "a.last"),
        "token_set": token_set_udf("q.canonical", "a.canonical"), "first_compatible": _near(F.col("q.first"), F.col("a.first")),
        "first_exact": (F.col("q.first") == F.col("a.first")).cast("double"), "last_exact": (F.col("q.last") == F.col("a.last")).cast("double"),
        "middle_compatible": middle, "query_has_initials": F.col("q.has_initials").cast("double"), "query_reordered": F.col("q.reordered").cast("double"),
        "token_gap": F.abs(F.size("q.tokens") - F.size("a.tokens")).cast("double"),
    }).drop("q", "a")
    if signals is None:
        return rows.withColumns({k: F.lit(0.0) for k in [*SIGNALS, "inverse_rank"]})
    given = signals.select("query_id", "customer_id", *SIGNALS, (F.lit(1.0) / F.col("rank")).alias("inverse_rank"))
    return rows.join(given, ["query_id", "customer_id"], "left").fillna(0.0, [*SIGNALS, "inverse_rank"])


FEATURES = [
    *SIGNALS, "inverse_rank", "jw_full", "jw_first", "jw_last", "token_set", "first_compatible", "first_exact", "last_exact", "middle_compatible",
    "query_has_initials", "query_reordered", "token_gap",
]


def first_stage(queries: DataFrame, entries: DataFrame, dense_scores: DataFrame, k: int = FIRST_STAGE) -> DataFrame:
    """(query_id, customer_id, rank, SIGNALS): the k best of the hybrid list with their scores in every list.

    dense_scores: (query_id, customer_id, score), the best alias of each customer.
    """
    lists = {"bm25": lexical(queries, entries), "bm25_char": lexical(queries, entries, "trigrams"), "dense": dense_scores}
    best = top(hybrid(lists["bm25_char"], lists["dense"]), k).select("query_id", "customer_id", F.col("score").alias("hybrid"), "rank")
    names = queries.select("query_id", F.col("name").alias("q_name"))
    lists["fuzzy"] = fuzzy(best.select("query_id", "customer_id").join(names, "query_id").join(entries.select("customer_id", "name"), "customer_id"))
    for name, scores in lists.items():
        best = best.join(scores.select("query_id", "customer_id", F.col("score").alias(name)), ["query_id", "customer_id"], "left")
    return best.fillna(0.0, list(lists))


def full_system(model, queries: DataFrame, entries: DataFrame, customers: DataFrame, stage: DataFrame) -> DataFrame:
    """The composed system: the first stage's pairs, reranked by the model, then verified by birth date and address."""
    named = stage.select("query_id", "customer_id").join(queries.select("query_id", F.col("name").alias("q_name")), "query_id")
    pairs = named.join(entries.select("customer_id", "name"), "customer_id")
    ranked = reranked(model, pair_features(pairs, stage), FIRST_STAGE)
    return top(verified(ranked.drop("rank"), queries, customers), TOP, "final")


def namesakes(people: DataFrame, gold: DataFrame) -> DataFrame:
    """(customer_id, other_id), both ways: people of one name who are not one person by gold (customer_id, same_id).

    A name of many people gives a row for each two of them, which is what is asked for.
    """
    other = people.select("name", F.col("customer_id").alias("other_id"))
    pairs = people.select("name", "customer_id").join(other, "name").filter("customer_id <> other_id").drop("name")
    known = gold.select(F.col("customer_id"), F.col("same_id").alias("other_id"))
    return pairs.join(known.unionByName(known.select(F.col("other_id").alias("customer_id"), F.col("customer_id").alias("other_id"))), ["customer_id", "other_id"], "left_anti")


def fit_reranker(labelled: DataFrame, trees: int = 50):
    """A boosted-tree reranker of pair features (a substitute in kind for other boosted trees)."""
    model = GBTClassifier(featuresCol="features", labelCol="label", maxDepth=3, maxIter=trees, stepSize=0.1, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"), model]).fit(labelled)


def reranked(model, features: DataFrame, k: int = TOP) -> DataFrame:
    scored = model.transform(features).withColumn("score", vector_to_array("probability")[1]).select("query_id", "customer_id", "score")
    return top(scored, k)


def own_rank(ranked: DataFrame, owners: DataFrame, strong: float = 0.75) -> DataFrame:
    """Per query: the rank and score of its own customer, and how many others score `strong` or more."""
    rows = ranked.join(owners.withColumnRenamed("customer_id", "owner"), "query_id")
    mine = F.col("customer_id") == F.col("owner")
    return rows.groupBy("query_id").agg(
        F.min(F.when(mine, F.col("rank"))).alias("own_rank"), F.max(F.when(mine, F.col("score"))).alias("own_score"),
        F.count_if(~mine & (F.col("score") >= strong)).alias("other_strong"),
    )
