"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation over Spark.

Vectors are scaled and floored to integers; the fit list is each distinct one
once, centred by its exact sums. Every step of the bidiagonalisation is one pass
over the fit list in which each row gives its part of Xv and of X'(Xv), so a left
vector is never stored: it is X times a short vector that the driver holds. A
pass also gives the products with all earlier left vectors, which are taken off;
right vectors are made orthogonal to all earlier ones on the driver. What goes
there is the width of the vectors squared at most, whatever the number of rows.
The small bidiagonal matrix's singular vectors give components and variances.

When the wanted components have converged, the steps go on to the full width if
that takes no longer than what was done; otherwise the converged triples are
kept and the steps begin again with another vector, so that no component hides
behind an equal variance. A break-down (a zero on the diagonal or beside it)
begins again likewise, so repeated variances and dependent dimensions are found.

Nulls: vectors that are null or hold null or non-finite entries take no part.
Shorter vectors count as ending in zeros. A null id stays null; repeated rows are
returned as often as they occur but fitted once. Components without variance are
left out, so one distinct vector, like an empty table, gives no rows. Entries
whose scaled value passes 64 bits count as the largest long of their sign, and a
deviation that passes 64 bits is null. Only the id and the vector are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import halved, table, written

SCALE = 256
COMPONENTS = 4
#: Singular values below this part of the Frobenius norm count as zero.
ZERO = 1e-13
#: A singular triple has converged at a residual below this part of the largest value.
CONVERGED = 1e-14
#: What a pass takes off a left vector, as part of its square, from which on a second pass checks it.
AGAIN = 1e-6
SEED = 20_000


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """Usable rows: the id and x, the scaled and floored vector."""
    finite = F.forall(vector_col, lambda c: (c.cast("double") > F.lit(float("-inf"))) & (c.cast("double") < F.lit(float("inf"))))
    return df.filter(F.coalesce(finite, F.lit(False))).select(
        F.col(id_col), F.transform(vector_col, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("x")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of a matrix; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Centre:
    """The fit list's number of vectors and their exact sums, and centring by them."""

    n: int
    sums: list[int]

    def __post_init__(self):
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        self.near = np.array(near, np.int64)
        self.rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, near)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums/n, as exact as doubles can hold it."""
        if len(x) and max(abs(float(x.max())), abs(float(x.min()))) >= 2.0**61:
            return x.astype(float) - self.near.astype(float) - self.rest
        return (x - self.near) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - sums) squared; None beyond 64 bits."""
        most = self.n * max(abs(float(x.max())), abs(float(x.min())), 1.0) + max((abs(s) for s in self.sums), default=0)
        if most**2 * max(len(self.sums), 1) < 2.0**62:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        found = (sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist())
        return [v if v < 1 << 63 else None for v in found]


def _summed(fit: DataFrame, of_part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over the fit list of of_part(rows), a vector; only one value a place reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in halved(batch):
                found = of_part(_matrix(part.column(0), width))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

    rows = fit.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value")).collect()
    out = np.zeros(len(rows))
    for place, value in rows:
        out[place] = value
    return out


def _exact_sums(fit: DataFrame, width: int) -> list[int]:
    """The sums of each dimension, in halves of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            for part in halved(batch):
                x = _matrix(part.column(0), width)
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                total = [t + (h << 32) + v for t, h, v in zip(total, high, low)]
        kinds = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(t) for t in total], kinds)], names=["place", "value"])

    rows = fit.mapInArrow(run, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value")).collect()
    out = [0] * width
    for place, value in rows:
        out[place] = int(value)
    return out


def _off(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """vector, orthogonal to the basis (twice is enough)."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            vector = vector - b.T @ (b @ vector)
    return vector


class Bidiagonalisation:
    """Singular triples of the centred fit list, from products with it alone.

    product(r, shorts) gives, for y = Xr and the earlier left vectors U = X shorts:
    X'y, U'y and y'y, by one pass over the rows.
    """

    def __init__(self, product: Callable[[np.ndarray, np.ndarray], tuple], width: int, norm: float, wanted: int):
        self.product, self.width, self.zero, self.wanted = product, width, ZERO * norm, wanted
        self.random = np.random.default_rng(SEED)
        self.right: list[np.ndarray] = []
        self.short: list[np.ndarray] = []  # left vector i is X short[i]
        self.back: list[np.ndarray] = []  # X' times left vector i
        self.entries: dict[tuple[int, int], float] = {}
        self.passes = 0

    def start(self) -> np.ndarray:
        while True:
            v = _off(self.random.normal(size=self.width), self.right)
            if (size := np.linalg.norm(v)) > 1e-6:
                return v / size

    def left(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """r with Xr orthogonal to all left vectors, X'Xr and the length of Xr."""
        while True:
            back, overlap, square = self.product(r, np.array(self.short).reshape(-1, self.width))
            self.passes += 1
            if not self.short:
                return r, back, max(square, 0.0) ** 0.5
            r, back = r - np.array(self.short).T @ overlap, back - np.array(self.back).T @ overlap
            taken = float(overlap @ overlap)
            if taken <= AGAIN * square or square - taken <= self.zero**2:
                return r, back, max(square - taken, 0.0) ** 0.5

    def small(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        matrix = np.zeros((len(self.short), len(self.right)))
        for at, value in self.entries.items():
            matrix[at] = value
        return np.linalg.svd(matrix, full_matrices=False)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """The largest singular values, falling, and their right vectors as rows."""
        v, before, beside, kept = self.start(), None, 0.0, 0
        while True:
            self.right.append(v)
            j = len(self.right) - 1
            r, back, size = self.left(v if before is None else v - beside * before)
            ended = size <= self.zero
            if not ended:
                self.short.append(r / size)
                self.back.append(back / size)
                i = len(self.short) - 1
                self.entries[i, j] = size
                rest = _off(self.back[i] - size * v, self.right)
                beside = float(np.linalg.norm(rest))
                ended = beside <= self.zero
            if len(self.right) == self.width:
                return self.found(min(self.wanted, len(self.short)))
            if not ended and len(self.short) > self.wanted and self.converged(beside, kept):
                if 2 * len(self.right) >= self.width:
                    pass  # to the end: no more passes than a second beginning
                elif kept:
                    return self.found(self.wanted)
                else:
                    kept = self.restart()
                    v, before = self.start(), None
                    continue
            if ended:
                v, before = self.start(), None
            else:
                v, before = rest / beside, self.short[-1]
                self.entries[i, j + 1] = beside

    def converged(self, beside: float, kept: int) -> bool:
        """Whether the wanted values, and after a second beginning the largest of the new ones, no longer change."""
        u, values, _ = self.small()
        residuals = beside * np.abs(u[-1])
        fresh = np.linalg.norm(u[kept:], axis=0) > 0.5 if kept else np.zeros(len(values), bool)
        first = np.flatnonzero(fresh)[:1]
        return bool((residuals[: self.wanted] <= CONVERGED * values[0]).all() and (residuals[first] <= 1e-3 * values[first]).all())

    def found(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        _, values, rows = self.small()
        most = min(most, int((values > self.zero).sum()))
        return values[:most], rows[:most] @ np.array(self.right)

    def restart(self) -> int:
        """Keeps the wanted triples alone."""
        values, vectors = self.found(self.wanted)
        self.right = list(vectors)
        self.short = [v / s for v, s in zip(vectors, values)]
        self.back = [v * s for v, s in zip(vectors, values)]
        self.entries = {(i, i): float(s) for i, s in enumerate(values)}
        return len(values)


@dataclass
class Whitening:
    """A fitted whitening: components are rows, variances fall."""

    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    scale: int
    passes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components.T / np.sqrt(self.variances)


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The whitening of the distinct usable vectors; None if there are none."""
    rows = integers(df.select(F.lit(0).alias("id"), F.col(vector_col)), "id", vector_col, scale).select("x")
    width = rows.agg(F.max(F.size("x"))).head()[0]
    if not width:
        return None
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    distinct = written(rows.select(padded.alias("x")).distinct(), "whitening")
    centre = Centre(distinct.count(), _exact_sums(distinct, width))
    square = float(_summed(distinct, lambda x: np.array([(centre.centred(x) ** 2).sum()]), width)[0])

    def product(r: np.ndarray, shorts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def of_part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            y = c @ r
            return np.concatenate((c.T @ y, (c @ shorts.T).T @ y, [y @ y]))

        total = _summed(distinct, of_part, width)
        return total[:width], total[width:-1], float(total[-1])

    if not square:
        return Whitening(centre, np.zeros((0, width)), np.zeros(0), 0.0, 0.0, scale, 0)
    steps = Bidiagonalisation(product, width, square**0.5, components)
    values, vectors = steps.run()
    model = Whitening(centre, vectors, values**2 / centre.n, square / centre.n, 0.0, scale, steps.passes)
    k = len(values)
    mean = _summed(distinct, lambda x: model.scores(x).sum(axis=0), width) / centre.n

    def outer(x: np.ndarray) -> np.ndarray:
        z = model.scores(x) - mean
        return (z.T @ z).ravel()

    covariance = _summed(distinct, outer, width).reshape(k, k) / centre.n
    model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def whitened(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable row of df and component: the score, its variance's share, and the row's deviation."""
    rows = integers(df.select(id_col, vector_col), id_col, vector_col, model.scale)
    id_type = rows.schema[id_col].dataType.simpleString()
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    k, width = len(model.variances), len(model.centre.sums)
    shares = model.variances / model.trace if k else model.variances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in halved(batch):
                x, m = _matrix(part.column(1), width), part.num_rows
                taken = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(taken), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.centre.n)), pa.array(model.centre.deviations(x), pa.int64()).take(taken),
                    pa.array(model.scores(x).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, model.identity_error)),
                ], names=names)

    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.filter(F.lit(k > 0)).mapInArrow(run, schema)


def op13_whitening(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    model = fit(embeddings) or Whitening(Centre(1, []), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, SCALE, 0)
    return whitened(embeddings, model)
