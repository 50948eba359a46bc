"""Causal history features per customer as window expressions.

Rows: customer, t (whole seconds), pos (breaks ties), and what is measured. The
features use positional priors (earlier in (t, pos)); behaviour and governance
use strictly earlier times. Windows that share keys share one shuffle and sort.
"""

from __future__ import annotations

from heapq import heappop, heappush, heappushpop

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import written

MIN_HISTORY, MIN_DEVIATION, LONG_GAP = 5, 0.25, 30 * 86_400
SPANS = {"10min": 600, "1h": 3600, "24h": 86_400, "7d": 604_800}
BAND, BAND_START, BAND_DAYS, BAND_COUNT = 10_000.0, 0.9, 30, 3


def ordered() -> Window:
    return Window.partitionBy("customer").orderBy("t", "pos")


def prior() -> Window:
    return ordered().rowsBetween(Window.unboundedPreceding, -1)


def trailing(seconds: int) -> Window:
    return Window.partitionBy("customer").orderBy("t").rangeBetween(-seconds, 0)


def with_counts(df: DataFrame) -> DataFrame:
    """Prior rows in all, and in trailing spans (lower edge inside, the row and later ties outside)."""
    rows = df.withColumn("rn", F.row_number().over(ordered()))
    return rows.withColumns(
        {f"n_{name}": F.col("rn") - F.min("rn").over(trailing(s)) for name, s in SPANS.items()} | {"n_prior": F.col("rn") - 1}
    ).drop("rn")


def with_amounts(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Statistics of earlier amounts: mean and deviation of logs, z, maximum, and the last day's sum."""
    log = F.log1p(F.col(amount))
    n = F.row_number().over(ordered()) - 1
    deviation = F.greatest(F.sqrt(F.greatest(F.var_pop("log_amount").over(prior()), F.lit(0.0))), F.lit(MIN_DEVIATION))
    rows = df.withColumn("log_amount", log).withColumns({
        "n_prior": n, "mean_log": F.coalesce(F.avg("log_amount").over(prior()), F.lit(0.0)),
        "z": F.when(n >= MIN_HISTORY, (F.col("log_amount") - F.avg("log_amount").over(prior())) / deviation).otherwise(0.0),
        "above_max": F.when(n >= MIN_HISTORY, F.col("log_amount") - F.max("log_amount").over(prior())).otherwise(0.0),
        "before": F.coalesce(F.sum(amount).over(prior()), F.lit(0.0)),
    })
    return rows.withColumn("sum_24h", F.greatest(F.col("before") - F.min("before").over(trailing(86_400)), F.lit(0.0))).drop("before")


def with_rhythm(df: DataFrame, hour: str = "hour") -> DataFrame:
    """Seconds since the row before (log), and distance from the mean earlier hour."""
    gap = F.coalesce(F.col("t") - F.lag("t").over(ordered()), F.lit(LONG_GAP))
    return df.withColumns({"log_gap": F.log1p(gap.cast("double")), "hour_off": F.coalesce(F.abs(F.col(hour) - F.avg(hour).over(prior())), F.lit(0.0))})


def with_novelty(df: DataFrame, amount: str = "amount") -> DataFrame:
    """How often the counterparty, its country, and this rounded amount to it came before."""
    def before(*keys) -> Column:
        return F.row_number().over(Window.partitionBy("customer", *keys).orderBy("t", "pos")) - 1

    return df.withColumn("rounded", F.bround(amount, 2)).withColumns({
        "n_counterparty": before("counterparty"), "new_country": before("country") == 0, "n_same_amount": before("counterparty", "rounded"),
    }).withColumn("new_counterparty", F.col("n_counterparty") == 0).drop("rounded")


def with_sequence(df: DataFrame, fields: list[str], length: int = 20) -> DataFrame:
    """The last `length` rows up to this one as an array of structs, with their times to this row and to the one before."""
    recent = F.collect_list(F.struct("t", *fields)).over(ordered().rowsBetween(1 - length, 0))
    rows = df.withColumn("recent", recent)
    gaps = F.transform("recent", lambda x, i: F.struct(
        (F.col("t") - x["t"]).alias("to_now"),
        F.when(i > 0, x["t"] - F.get("recent", i - 1)["t"]).otherwise(F.lit(0)).alias("to_previous")))
    return rows.withColumns({"gaps": gaps, "padding": F.lit(length) - F.size("recent")})


#: A key of more rows is split over tasks, into times of about so many rows.
HOT_ROWS = 200_000


class _Halves:
    """The lower and the upper half of numbers that come one by one; `below` others are smaller and were never seen."""

    def __init__(self, values=(), below: int = 0, n: int = 0):
        values = sorted(values)
        middle = (n + 1) // 2 - below
        self.low, self.high, self.below, self.n = [-v for v in reversed(values[:middle])], values[middle:], below, n
        self.now, self.waiting = None, []

    def add(self, v: float) -> None:
        self.n += 1
        heappush(self.high, -heappushpop(self.low, -v))
        if self.below + len(self.low) < (self.n + 1) // 2:
            heappush(self.low, -heappop(self.high))

    def seen(self, t, x: float | None) -> float | None:
        """The median of the values of times before t; x is the value at t. Rows come in order of time."""
        if t != self.now:
            for v in self.waiting:
                self.add(v)
            self.now, self.waiting = t, []
        if x is not None:
            self.waiting.append(float(x))
        return None if not self.n else -self.low[0] if self.n % 2 else 0.5 * -self.low[0] + 0.5 * self.high[0]


def with_prior_median(df: DataFrame, value: str, key: str = "customer", time: str = "micros", most: int = HOT_ROWS) -> DataFrame:
    """df with `typical`, the median of the key's values at strictly earlier times; keys and times may be null, and rows may repeat.

    Two heaps hold the values of one key while its rows stream by in order of
    time: each row costs a logarithm, where a window would sort its whole frame.
    Keys of more than `most` rows are split into times, each of which is one
    task: while its rows come, the median moves by no more ranks than it has
    rows, so of all earlier values it needs only those of so many ranks round
    their median, and how many lie below. These follow from counts by time and
    range of values; what is sent is about four times the rows of such keys.
    """
    schema = StructType([*df.schema.fields, StructField("typical", DoubleType())])

    def run(batches):
        who, halves = object(), None
        for batch in batches:
            out = []
            for k, t, x in zip(*(batch.column(c).to_pylist() for c in (key, time, value))):
                if k != who:
                    who, halves = k, _Halves()
                out.append(halves.seen(t, x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=schema.names)

    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") > most) & F.col(key).isNotNull())
    largest = counts.agg(F.max("__n")).head()[0]
    if largest is None:
        return df.repartition(key).sortWithinPartitions(key, time).mapInArrow(run, schema)
    hot = counts.select(key)
    rest = df.join(hot, key, "left_anti").select(*df.columns)
    rest = rest.repartition(key).sortWithinPartitions(key, time).mapInArrow(run, schema)
    return rest.unionByName(_split_medians(df.join(hot, key, "left_semi").select(*df.columns), schema, value, key, time, -(-largest // most)))


def _split_medians(df: DataFrame, schema: StructType, value: str, key: str, time: str, parts: int) -> DataFrame:
    """with_prior_median for keys of many rows: `parts` times and as many ranges of values a key."""
    shares = [i / parts for i in range(1, parts)] or [0.5]
    edges = df.groupBy(key).agg(F.percentile_approx(time, shares, 20 * parts).alias("__times"), F.percentile_approx(value, shares, 20 * parts).alias("__values"))

    def at(x: str, ends: str) -> Column:
        """How many ends lie at or below x; 0 where x is null."""
        return F.coalesce(F.aggregate(ends, F.lit(0), lambda n, e: n + F.when(e <= F.col(x), 1).otherwise(0)), F.lit(0))

    placed = df.join(edges, key).withColumns({"__part": at(time, "__times"), "__range": at(value, "__values")}).drop("__times", "__values")
    placed = written(placed, "hot-history")
    valued = placed.filter(F.col(value).isNotNull())
    cells = valued.groupBy(key, "__part", "__range").agg(F.count(F.lit(1)).alias("n"))
    grid = edges.select(key, F.explode(F.sequence(F.lit(0), F.lit(len(shares)))).alias("__part")).withColumn("__range", F.explode(F.sequence(F.lit(0), F.lit(len(shares)))))
    cells = grid.join(cells, [key, "__part", "__range"], "left").fillna(0, ["n"])
    earlier = Window.partitionBy(key, "__range").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    part, upward = Window.partitionBy(key, "__part"), Window.partitionBy(key, "__part").orderBy("__range")
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    cells = cells.withColumns({"m": F.sum("before").over(part), "own": F.sum("n").over(part), "upto": F.sum("before").over(upward)})
    middle, reach = F.floor(F.col("m") / 2), F.col("own") + 2
    needed = cells.filter((F.col("before") > 0) & (F.col("upto") >= middle - reach) & (F.col("upto") - F.col("before") <= middle + reach))
    needed = needed.withColumn("below", F.min(F.col("upto") - F.col("before")).over(part)).select(
        F.col(key).alias("__key"), F.col("__part").alias("__to"), F.col("__range").alias("__of"), "m", "below")
    sent = valued.join(needed, (F.col(key) == F.col("__key")) & (F.col("__range") == F.col("__of")) & (F.col("__part") < F.col("__to"))).select(
        "__key", F.col("__to").alias("__at"), "m", "below", F.col(value).cast("double").alias("v"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(schema.names[:-1])
        if not left.num_rows:
            return left.append_column("typical", pa.array([], pa.float64()))
        halves = _Halves(right["v"].to_pylist(), right["below"][0].as_py(), right["m"][0].as_py()) if right.num_rows else _Halves()
        left = left.take(pc.sort_indices(left, [(time, "ascending")], null_placement="at_start"))
        return left.append_column("typical", pa.array([halves.seen(t, x) for t, x in zip(left[time].to_pylist(), left[value].to_pylist())], pa.float64()))

    return placed.groupBy(key, "__part").cogroup(sent.groupBy("__key", "__at")).applyInArrow(run, schema)


def behaviour(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Facts against strictly earlier rows: counts, typical ratio, seen counterparty and country, identical transfers.

    `micros` is the time in microseconds.
    """
    strictly = Window.partitionBy("customer").orderBy("micros")

    def back(micros: int | None) -> Window:
        return strictly.rangeBetween(Window.unboundedPreceding if micros is None else -micros, -1)

    df = with_prior_median(df, amount)
    typical = F.col("typical")
    first = {k: F.min("micros").over(Window.partitionBy("customer", k)) for k in ("counterparty", "country")}
    same = Window.partitionBy("customer", "counterparty", amount).orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumns({
        "n_prior": F.count(F.lit(1)).over(back(None)), "n_10min": F.count(F.lit(1)).over(back(600_000_000)),
        "n_24h": F.count(F.lit(1)).over(back(86_400_000_000)), "typical_ratio": F.when(typical != 0, F.col(amount) / typical),
        "counterparty_seen": first["counterparty"] < F.col("micros"), "country_seen": first["country"] < F.col("micros"),
        "n_identical": F.count(F.lit(1)).over(same),
    }).drop("typical")


def structuring(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Count of just-below-threshold rows of one currency in 30 days (this row too, if it is one); flag from 3."""
    inside = F.when((F.col(amount) >= BAND_START * BAND) & (F.col(amount) < BAND), 1).otherwise(0)
    earlier = Window.partitionBy("customer", "currency").orderBy("micros").rangeBetween(-BAND_DAYS * 86_400_000_000, -1)
    rows = df.withColumn("in_band", inside)
    return rows.withColumn("n_band", F.coalesce(F.sum("in_band").over(earlier), F.lit(0)) + F.col("in_band")).withColumn(
        "structuring", F.col("n_band") >= BAND_COUNT
    )


def new_cross_border(df: DataFrame) -> DataFrame:
    """Whether a country is met for the first time, across a border."""
    first = F.min("micros").over(Window.partitionBy("customer", "country"))
    return df.withColumn("new_cross_border", (first == F.col("micros")) & (F.col("sender_country") != F.col("receiver_country")))


def chronological_split(df: DataFrame, time: str = "t", shares: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """Rows with split train, validation or test, by exact quantiles of time (cut0, cut1)."""
    cuts = quantiles(df, time, shares)
    place = F.when(F.col(time) < F.col("cut0"), "train").when(F.col(time) < F.col("cut1"), "validation").otherwise("test")
    return df.withColumns({f"cut{i}": F.lit(c).cast("double") for i, c in enumerate(cuts)}).withColumn("split", place)


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], buckets: int = 2048) -> list[float | None]:
    """Exact interpolated quantiles of a number, however many rows there are.

    Each pass counts the rows of equal ranges and goes on in the ranges that hold
    the wanted ranks, until these hold one value each: at most a few thousand
    counts reach the driver in a pass, and no buffer holds the values.
    """
    x = F.col(value)
    n, least, most = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return [None for _ in shares]
    places = [s * (n - 1) for s in shares]
    # Wanted rank: the range that holds its value, and how many rows lie before the range.
    at = {r: (least, most, 0) for p in places for r in (int(p), min(int(p) + 1, n - 1))}
    while open_ := sorted({a for a in at.values() if a[0] < a[1]}):
        bucket = F.lit(None).cast("int")
        for i, (lo, hi, _) in enumerate(open_):
            step = F.least(F.floor((x - lo) / float(hi - lo) * buckets).cast("int"), F.lit(buckets - 1))
            bucket = F.when((x >= lo) & (x <= hi), step + i * buckets).otherwise(bucket)
        counts = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).filter("b is not null").orderBy("b").collect()
        for i, (lo, hi, before) in enumerate(open_):
            for row in (r for r in counts if r["b"] // buckets == i):
                for rank, a in at.items():
                    if a == (lo, hi, open_[i][2]) and before <= rank < before + row["n"]:
                        at[rank] = (row["lo"], row["hi"], before)
                before += row["n"]
    return [at[int(p)][0] + (at[min(int(p) + 1, n - 1)][0] - at[int(p)][0]) * (p - int(p)) for p in places]


def purged(split: DataFrame, episode: str = "episode", time: str = "t") -> DataFrame:
    """split without the rows of episodes that lie across a boundary."""
    extent = split.filter(F.col(episode).isNotNull()).groupBy(episode).agg(
        F.min(time).alias("lo"), F.max(time).alias("hi"), F.first("cut0").alias("c0"), F.first("cut1").alias("c1")
    )
    across = extent.filter(((F.col("lo") < F.col("c0")) & (F.col("c0") <= F.col("hi"))) | ((F.col("lo") < F.col("c1")) & (F.col("c1") <= F.col("hi"))))
    return split.join(across.select(episode), episode, "left_anti")


def entity_split(df: DataFrame, entity: str, seed: int, shares: tuple[float, float] = (0.5, 0.7)) -> DataFrame:
    """train, dev or test per entity by hash: no global order, so no single task."""
    u = F.pmod(F.xxhash64(F.col(entity), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return df.withColumn("split", F.when(u < shares[0], "train").when(u < shares[1], "dev").otherwise("test"))


def leaks(split: DataFrame, time: str = "t", order: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """(earlier, later, latest, first): splits that hold rows at or after the first row of a later split; none in a proper split."""
    ends = split.groupBy("split").agg(F.min(time).alias("first"), F.max(time).alias("latest"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("split"))
    a = ends.select(F.col("split").alias("earlier"), place.alias("i"), "latest")
    b = ends.select(F.col("split").alias("later"), place.alias("j"), "first")
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).filter(F.col("latest") >= F.col("first")).select("earlier", "later", "latest", "first")  # a row a split


def assert_no_leak(split: DataFrame, time: str = "t") -> None:
    """An error if a split holds rows of a later one's time."""
    if found := leaks(split, time).take(1):
        raise ValueError(f"{found[0]['earlier']} reaches into {found[0]['later']}")
