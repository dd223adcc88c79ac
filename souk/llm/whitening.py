"""Embedding whitening by polarisation: covariances out of variances.

Entries become integers, so that all sums are exact. One pass gives the number of vectors and the sum
of each dimension. The next sums the squares of the centred values of every dimension i and of every
sum of two dimensions i + j; since var(i + j) = var(i) + var(j) + 2 cov(i, j), these squares alone
give the whole covariance matrix. Only that matrix, whose size follows the dimensions and not the
vectors, reaches the driver for its eigenvectors.

Values are centred at the whole number below their mean, so squares stay small; what that leaves of
the mean is taken out exactly: n * sum(w^2) - (sum w)^2, in unbounded integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SCALE, SHIFT = 1024, 100_000
LIMIT = 1 << 40  # whole numbers beyond are held at it, so that batch sums of squares fit in 128 bits
ROWS = 1_024  # vectors handled at once


@dataclass(frozen=True)
class Fit:
    """What the driver knows of the fit list."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float

    def scales(self) -> np.ndarray:
        """1 / sqrt(e) for each component; 0 where a component has no variance but rounding."""
        least = len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        return np.where(self.values > least, 1 / np.sqrt(np.maximum(self.values, np.finfo(float).tiny)), 0.0)


def whole(entries: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of finite doubles, as int64."""
    return np.clip(np.floor(entries.astype(np.float64) * SCALE), -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT


def _vectors(batches: Iterable[pa.RecordBatch], dims: int | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and entries of usable vectors, by length, some at once; `dims`: only those of this length."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            lists = part.column("v")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]):
                if dims is not None and size != dims:
                    continue
                rows = part.take(pa.array(np.flatnonzero(sizes == size)))
                flat = pc.list_flatten(rows.column("v"))
                values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
                good = np.isfinite(values).all(axis=1)
                if good.any():
                    yield rows.column("key").filter(pa.array(good)), values[good]


def _rows(sums: dict, names: list[str]) -> pa.RecordBatch:
    """One row for each key of `sums` and its exact sums as decimals."""
    keys = list(zip(*sums, strict=True)) if sums else [[]] * len(names)
    width = len(next(iter(sums.values()))) if sums else 0
    decimals = [pa.array([Decimal(int(v[i])) for v in sums.values()], pa.decimal128(38, 0)) for i in range(width)]
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), *decimals], [*names, *(f"s{i}" for i in range(width))])


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each vector length and dimension: vectors and sum."""
    sums: dict[int, list] = {}
    for _, values in _vectors(batches, None):
        own = sums.setdefault(values.shape[1], [0, np.zeros(values.shape[1], object)])
        own[0] += len(values)
        own[1] = own[1] + whole(values).sum(axis=0).astype(object)
    for size, (n, total) in sums.items():
        yield _rows({(size, i): (n, t) for i, t in enumerate(total)}, ["size", "i"])


def _squares(dims: int, centre: tuple[int, ...]) -> Callable:
    """For each dimension (i, i) and pair (i, j): the sum of its centred values, and that of their squares."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centre, np.int64)
        first = np.zeros(dims, object)
        second = np.zeros((dims, dims), object)
        small, room = np.zeros((dims, dims), np.int64), 2**62

        for _, values in _vectors(batches, dims):
            z = whole(values) - middle
            first = first + z.sum(axis=0).astype(object)
            most = 4 * int(np.abs(z).max()) ** 2 * len(z)
            if most >= 2**62:  # such squares do not fit in 64 bits
                z, most = z.astype(object), 0
            elif most > room:
                second, small, room = second + small.astype(object), np.zeros_like(small), 2**62
            room -= most
            to = small if z.dtype != object else second
            for i in range(dims):
                pair = z[:, i:] + z[:, i : i + 1]
                pair[:, 0] = z[:, i]
                to[i, i:] += (pair * pair).sum(axis=0)
        second = second + small.astype(object)
        if any(first) or second.any():
            sums = {(i, j): (first[i] + (first[j] if j > i else 0), second[i, j]) for i in range(dims) for j in range(i, dims)}
            yield _rows(sums, ["i", "j"])

    return run


def covariance(n: int, dims: int, sums: dict[tuple[int, int], tuple[int, int]]) -> np.ndarray:
    """The covariance matrix, divisor n, out of the sums and sums of squares of dimensions and pairs."""
    spread = {key: n * squares - total * total for key, (total, squares) in sums.items()}  # n^2 variances, exact
    out = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            exact = spread.get((i, j), 0)
            twice = 2 * exact if i == j else exact - spread.get((i, i), 0) - spread.get((j, j), 0)
            out[i, j] = out[j, i] = float(Fraction(twice, 2 * n * n))
    return out


def fit(vectors: DataFrame) -> Fit | None:
    """Mean and components of the usable vectors of column v (arrays of numbers); None if there are none.

    Their length is that of most of them (of the longer ones at a tie). The driver gets one row for each
    dimension and pair of dimensions.
    """
    totals = vectors.mapInArrow(_totals, "size bigint, i bigint, s0 decimal(38,0), s1 decimal(38,0)")
    totals = totals.groupBy("size", "i").agg(F.sum("s0").alias("n"), F.sum("s1").alias("s"))
    most = totals.where("i = 0").orderBy(F.desc("n"), F.desc("size")).take(1)
    if not most:
        return None
    n, dims = int(most[0].n), int(most[0].size)
    sums = tuple(int(r.s) for r in totals.where(F.col("size") == dims).orderBy("i").collect())
    squares = vectors.mapInArrow(_squares(dims, tuple(s // n for s in sums)), "i bigint, j bigint, s0 decimal(38,0), s1 decimal(38,0)")
    found = squares.groupBy("i", "j").agg(F.sum("s0").alias("s"), F.sum("s1").alias("q")).collect()
    matrix = covariance(n, dims, {(r.i, r.j): (int(r.s), int(r.q)) for r in found})
    values, axes = np.linalg.eigh(matrix)
    return Fit(n, sums, values[::-1].copy(), axes[:, ::-1].copy(), float(np.trace(matrix)))


def _projected(values: np.ndarray, model: Fit, top: int) -> np.ndarray:
    """Whitened values: x less the mean, in units of 1 over n so that nothing is rounded before, along each component."""
    x = whole(values)
    middle = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([(s - (s // model.n) * model.n) / model.n for s in model.sums])
    return ((x - middle) - rest) @ model.vectors[:, :top] * model.scales()[:top]


def _moments(model: Fit, top: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(top), np.zeros((top, top))
        for _, values in _vectors(batches, len(model.sums)):
            w = _projected(values, model, top)
            first += w.sum(axis=0)
            second += w.T @ w
        rows = [(i, -1, first[i]) for i in range(top)] + [(i, j, second[i, j]) for i in range(top) for j in range(top)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["i", "j", "s"])

    return run


def identity_error(vectors: DataFrame, model: Fit, top: int) -> float:
    """The largest absolute entry of the whitened values' covariance less the identity; for components without
    variance, whose whitened values are 0, the identity has a 0."""
    found = vectors.mapInArrow(_moments(model, top), "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    sums = {(r.i, r.j): r.s for r in found}
    n, scales = model.n, model.scales()
    return max(abs(sums[i, j] / n - sums[i, -1] * sums[j, -1] / n**2 - (i == j and scales[i] > 0)) for i in range(top) for j in range(top))


def _whitened(model: Fit, top: int, error: float, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(model.sums, object)
        explained = model.values[:top] / model.trace if model.trace > 0 else np.zeros(top)
        for key, values in _vectors(batches, len(model.sums)):
            rows, x = len(values), whole(values)
            off = np.abs(x - np.array([s // model.n for s in model.sums], np.int64)).max() + 1
            if len(sums) * (model.n * int(off)) ** 2 < 2**62:
                gap = model.n * x - sums.astype(np.int64)
            else:
                gap = model.n * x.astype(object) - sums
            deviation = pa.array([Decimal(int(d)) for d in (gap * gap).sum(axis=1)], pa.decimal128(38, 0))
            flat = np.repeat(np.arange(rows), top)
            columns = [
                key.take(pa.array(flat)),
                pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * top, model.n, np.int64)),
                deviation.take(pa.array(flat)),
                pa.array(_projected(values, model, top).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * top, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 8) -> DataFrame:
    """A row for each usable vector and each of its first `top` components: key, component, n, deviation,
    whitened, explained, identity_error.

    Entries c become x = floor(1024 c) + 100000. deviation is the exact sum of (n x - S)^2 over the
    dimensions, a decimal of 38 digits. Components are the unit eigenvectors of the covariance of x by
    falling eigenvalue; whitened is x less its mean along the component over the root of its eigenvalue,
    explained the eigenvalue's share of all, identity_error how far the whitened values of all rows are
    from uncorrelated unit variance.

    Dropped are vectors that are null or empty, hold nulls or non-finite entries, or have another length
    than most (they have no place in the components); no usable vector, no rows. Null keys, repeated rows
    and repeated vectors are rows like any other. Fewer dimensions than `top` give as many components. A
    component without variance has whitened and explained 0. Entries beyond about a billion are held
    there. Other columns are not read.
    """
    own = table.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v"))
    name = table.schema[key].dataType.simpleString()
    ddl = f"key {name}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(own)
    if model is None:
        return table.sparkSession.createDataFrame([], ddl).withColumnRenamed("key", key)
    top = min(top, len(model.sums))
    arrow = to_arrow_schema(table.sparkSession.createDataFrame([], ddl).schema)
    found = own.mapInArrow(_whitened(model, top, identity_error(own, model, top), arrow), ddl)
    return found.withColumnRenamed("key", key)
