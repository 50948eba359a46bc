"""Causal history, governance, and splits over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from .common import HISTORY, Slate, history, rounded

slate = Slate()
W = "(PARTITION BY customer ORDER BY t, pos)"
P = "(PARTITION BY customer ORDER BY t, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def R(seconds):
    return f"(PARTITION BY customer ORDER BY t RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"


COUNTS = f"WITH {HISTORY}, n AS (SELECT *, row_number() OVER {W} AS rn FROM h) "


@slate(COUNTS + f"SELECT transaction_id, rn - 1 AS n_prior, rn - min(rn) OVER {R(600)} AS n_10min, rn - min(rn) OVER {R(3600)} AS n_1h, rn - min(rn) OVER {R(86400)} AS n_24h, rn - min(rn) OVER {R(604800)} AS n_7d FROM n")
def trailing_counts(spark, sf_dir):
    rows = H.with_counts(history(spark, sf_dir))
    return rows.select("transaction_id", *[F.col(c).cast("long").alias(c) for c in ("n_prior", "n_10min", "n_1h", "n_24h", "n_7d")])


AMOUNTS = f"""WITH {HISTORY}, a AS (SELECT *, ln(1 + amount) AS la, row_number() OVER {W} - 1 AS n_prior FROM h),
b AS (SELECT *, avg(la) OVER {P} AS mean, var_pop(la) OVER {P} AS v, max(la) OVER {P} AS mx, coalesce(sum(amount) OVER {P}, 0) AS excl FROM a)"""


@slate(AMOUNTS + " SELECT transaction_id, n_prior, round(coalesce(mean, 0), 6) AS mean_log, round(CASE WHEN n_prior >= 5 THEN (la - mean) / greatest(sqrt(greatest(v, 0)), 0.25::double) ELSE 0 END, 6) AS z FROM b")
def prior_stats_z(spark, sf_dir):
    rows = H.with_amounts(history(spark, sf_dir)).withColumn("n_prior", F.col("n_prior").cast("long"))
    return rounded(rows.select("transaction_id", "n_prior", "mean_log", "z"), "mean_log", "z")


@slate(AMOUNTS + " SELECT transaction_id, round(CASE WHEN n_prior >= 5 THEN la - mx ELSE 0 END, 6) AS above_max FROM b")
def prior_max_delta(spark, sf_dir):
    return rounded(H.with_amounts(history(spark, sf_dir)).select("transaction_id", "above_max"), "above_max")


@slate(AMOUNTS + f" SELECT transaction_id, round(greatest(excl - min(excl) OVER {R(86400)}, 0), 4) AS sum_24h FROM b")
def trailing_sum_24h(spark, sf_dir):
    return rounded(H.with_amounts(history(spark, sf_dir)).select("transaction_id", "sum_24h"), "sum_24h", places=4)


@slate(f"WITH {HISTORY} SELECT transaction_id, round(ln(1 + coalesce(t - lag(t) OVER {W}, 2592000)::double), 6) AS log_gap, round(coalesce(abs(hour - avg(hour) OVER {P}), 0), 6) AS hour_off FROM h")
def gap_and_hour_deviation(spark, sf_dir):
    return rounded(H.with_rhythm(history(spark, sf_dir)).select("transaction_id", "log_gap", "hour_off"), "log_gap", "hour_off")


@slate(f"""WITH {HISTORY} SELECT transaction_id, row_number() OVER (PARTITION BY customer, counterparty ORDER BY t, pos) - 1 AS n_counterparty,
  row_number() OVER (PARTITION BY customer, country ORDER BY t, pos) = 1 AS new_country, row_number() OVER (PARTITION BY customer, counterparty, round_even(amount, 2) ORDER BY t, pos) - 1 AS n_same_amount,
  row_number() OVER (PARTITION BY customer, counterparty ORDER BY t, pos) = 1 AS new_counterparty FROM h""")
def new_counterparty(spark, sf_dir):
    rows = H.with_novelty(history(spark, sf_dir))
    return rows.select("transaction_id", F.col("n_counterparty").cast("long").alias("n_counterparty"), "new_country", F.col("n_same_amount").cast("long").alias("n_same_amount"), "new_counterparty")


S = "(PARTITION BY customer ORDER BY micros RANGE BETWEEN {} PRECEDING AND 1 PRECEDING)"


@slate(f"""WITH {HISTORY} SELECT transaction_id, count(*) OVER {S.format('UNBOUNDED')} AS n_prior, count(*) OVER {S.format(600000000)} AS n_10min, count(*) OVER {S.format(86400000000)} AS n_24h,
  round(amount / nullif(quantile_cont(amount, 0.5) OVER {S.format('UNBOUNDED')}, 0), 6) AS typical_ratio, min(micros) OVER (PARTITION BY customer, counterparty) < micros AS counterparty_seen,
  min(micros) OVER (PARTITION BY customer, country) < micros AS country_seen,
  count(*) OVER (PARTITION BY customer, counterparty, amount ORDER BY micros RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_identical FROM h""")
def behaviour_facts(spark, sf_dir):
    rows = H.behaviour(history(spark, sf_dir))
    return rounded(rows.select("transaction_id", "n_prior", "n_10min", "n_24h", "typical_ratio", "counterparty_seen", "country_seen", "n_identical"), "typical_ratio")


@slate(f"""WITH {HISTORY}, g AS (SELECT *, list(transaction_id) OVER (PARTITION BY customer ORDER BY t, pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ids FROM h)
SELECT transaction_id, len(ids) AS n, 20 - len(ids) AS padding, array_to_string(ids, ',') AS ids FROM g""")
def sequence_last20(spark, sf_dir):
    rows = H.with_sequence(history(spark, sf_dir), ["transaction_id"])
    ids = F.array_join(F.transform("recent", lambda x: x["transaction_id"].cast("string")), ",")
    return rows.select("transaction_id", F.size("recent").cast("long").alias("n"), F.col("padding").cast("long").alias("padding"), ids.alias("ids"))


@slate(f"""WITH {HISTORY}, b AS (SELECT *, CASE WHEN amount * 100 >= 9000 AND amount * 100 < 10000 THEN 1 ELSE 0 END AS i FROM h),
c AS (SELECT transaction_id, CAST(coalesce(sum(i) OVER (PARTITION BY customer ORDER BY micros RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING), 0) + i AS BIGINT) AS n_band FROM b)
SELECT transaction_id, n_band, n_band >= 3 AS structuring FROM c""")
def structuring(spark, sf_dir):
    rows = history(spark, sf_dir).withColumns({"amount": F.col("amount") * 100, "currency": F.lit("USD")})
    return H.structuring(rows).select("transaction_id", F.col("n_band").cast("long").alias("n_band"), "structuring")


@slate(f"WITH {HISTORY} SELECT transaction_id, min(micros) OVER (PARTITION BY customer, country) = micros AND country <> 'view' AS new_cross_border FROM h")
def new_country(spark, sf_dir):
    rows = history(spark, sf_dir).withColumns({"sender_country": F.lit("view"), "receiver_country": F.col("country")})
    return H.new_cross_border(rows).select("transaction_id", "new_cross_border")


SPLIT = f"""WITH {HISTORY}, q AS (SELECT quantile_cont(t, 0.6) AS c0, quantile_cont(t, 0.8) AS c1 FROM h), s AS (SELECT h.*, c0, c1, CASE WHEN t < c0 THEN 'train' WHEN t < c1 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN customer % 3 = 0 THEN customer * 1000 + t // 864000 END AS episode FROM h, q)"""


def _split(spark, sf_dir):
    rows = history(spark, sf_dir).withColumn("episode", F.when(F.col("customer") % 3 == 0, F.col("customer") * 1000 + F.floor(F.col("t") / 864000)))
    return H.chronological_split(rows)


@slate(SPLIT + " SELECT split, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY split")
def temporal_split(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@slate(SPLIT + ", e AS (SELECT episode, min(t) AS lo, max(t) AS hi FROM s WHERE episode IS NOT NULL GROUP BY 1) SELECT split, count(*) AS n FROM s WHERE episode IS NULL OR episode NOT IN (SELECT episode FROM e, q WHERE (lo < c0 AND c0 <= hi) OR (lo < c1 AND c1 <= hi)) GROUP BY split")
def episode_purge(spark, sf_dir):
    return H.purged(_split(spark, sf_dir)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@slate(f"WITH {HISTORY} SELECT transaction_id, round(ln(1 + amount), 6) AS log_amount, round(sin(2 * pi() * hour / 24), 6) AS hour_sin, round(cos(2 * pi() * hour / 24), 6) AS hour_cos, CASE WHEN hour < 6 THEN 1 ELSE 0 END AS night, "
       + ", ".join(f"CASE WHEN country = '{c}' THEN 1 ELSE 0 END AS is_{c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM h")
def basic_features(spark, sf_dir):
    h = F.col("hour") * (2 * 3.141592653589793 / 24)
    kinds = {f"is_{c}": (F.col("country") == c).cast("int") for c in ("click", "error", "purchase", "signup", "view")}
    rows = history(spark, sf_dir).withColumns({"log_amount": F.log1p("amount"), "hour_sin": F.sin(h), "hour_cos": F.cos(h), "night": (F.col("hour") < 6).cast("int")} | kinds)
    return rounded(rows.select("transaction_id", "log_amount", "hour_sin", "hour_cos", "night", *kinds), "log_amount", "hour_sin", "hour_cos")
