"""Whitening against exact sums and numpy's eigenvectors of the covariance computed from products."""

import math
from fractions import Fraction

import numpy as np
import pytest

from souk.llm import queries, whitening
from tests.llm import cases


def ints(vector):
    return [math.floor(1024 * c) + 100_000 for c in vector]


def check(found, vectors, top=8):
    """found: rows of whiten(); vectors: usable (key, entries)."""
    x = [ints(v) for _, v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dims)]
    exact = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(dims)] for i in range(dims)]
    values, axes = np.linalg.eigh(np.array(exact, float))
    values, axes = values[::-1], axes[:, ::-1]
    top = min(top, dims)
    assert len(found) == n * top
    assert {r.n for r in found} == {n}
    assert max(r.identity_error for r in found) < 1e-6
    assert sorted((r.vec_id is None, r.vec_id or 0, int(r.deviation)) for r in found if r.component == 1) == sorted((k is None, k or 0, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for (k, _), row in zip(vectors, x, strict=True))
    for c in range(top):
        rows = [r for r in found if r.component == c + 1]
        assert all(abs(r.explained - values[c] / values.sum()) <= 1e-9 for r in rows)
        want = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(row, sums, strict=True)] for row in x]) @ axes[:, c] / math.sqrt(values[c])
        got = {r.vec_id: r.whitened for r in rows}
        same = np.array([got[k] for k, _ in vectors])
        assert min(np.abs(same - want).max(), np.abs(same + want).max()) < 1e-6


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    basis = rng.normal(size=(9, 9))
    return [(None if i == 7 else i, [float(np.float32(c)) for c in rng.normal(size=9) @ basis + 3]) for i in range(150)]


def test_whiten(spark, vectors):
    odd = [(500, None), (501, []), (502, [None] + [1.0] * 8), (503, [float("nan")] * 9), (504, [1.0] * 8 + [float("inf")]), (505, [1.0, 2.0]), (506, [1.0] * 12)]
    table = cases.clash(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").repartition(5), "v", "component", "n", "i", "s0")
    check(whitening.whiten(table).collect(), vectors)
    few = [(k, v[:3]) for k, v in vectors]
    check(whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect(), few)


def test_repeats_ties_and_large_entries(spark, vectors):
    far = [(k, [1e6 * c for c in v]) for k, v in vectors] + [(900, [1e8] * 9), (901, [-1e8] + [0.0] * 8)] * 1
    check(whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect(), far)
    twice = vectors[10:60] * 2
    found = whitening.whiten(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).collect()
    check(found, twice)


def test_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    found = whitening.whiten(same).collect()
    assert {(r.component, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in found} == {(c, 0, 0.0, 0.0, 0.0) for c in (1, 2)}
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert {r.whitened for r in whitening.whiten(flat).collect() if r.component == 2} == {0.0}
    assert whitening.whiten(same.where("false")).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_query(spark, small):
    found = queries.op13_embedding_whitening(spark, small)
    assert found.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    check(found.collect(), [(r.vec_id, list(r.embedding)) for r in rows])
