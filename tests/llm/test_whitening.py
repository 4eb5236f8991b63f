import math

import numpy as np
import pytest

from inkspan.llm.queries import op11_whitening
from inkspan.llm.whitening import jacobi, whiten

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors):
    """Quantised rows, distinct list, its eigenvalues and eigenvectors, by numpy's own solver."""
    x = np.floor(256 * np.array(vectors, np.float32).astype(np.float64)) + 0
    fit = np.unique(x, axis=0)
    off = fit - fit.mean(axis=0)
    values, found = np.linalg.eigh(off.T @ off / len(fit))
    return x.astype(np.int64), fit, values[::-1], found[:, ::-1]


def check(rows, vectors, components):
    x, fit, values, found = brute(vectors)
    n, sums = len(fit), fit.sum(axis=0).astype(np.int64)
    whitened = ((x - fit.mean(axis=0)) @ found[:, :components]) / np.sqrt(values[:components])
    by_row = {(r.vec_id, r.component): r for r in rows}
    assert len(by_row) == len(rows) == len(x) * components
    for k in range(components):
        mine = np.array([by_row[i, k + 1].whitened for i in range(len(x))])
        sign = 1 if mine @ whitened[:, k] > 0 else -1
        assert np.allclose(mine, sign * whitened[:, k], atol=1e-8)
        assert all(math.isclose(by_row[i, k + 1].explained, values[k] / values.sum(), rel_tol=1e-9) for i in range(len(x)))
    for i in range(len(x)):
        assert by_row[i, 1].n == n and by_row[i, 1].deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], sums))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_query_equals_an_eigenvalue_solver(spark):
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    check(op11_whitening(spark, SF).collect(), vectors, 4)


def test_copies_have_no_say_and_bad_rows_go(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 2, (40, 5)).astype(np.float32).tolist()
    vectors += [vectors[7]] * 200
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [1.0, math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0, 0.0], [3e38, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [*enumerate(vectors), *((1000 + i, v) for i, v in enumerate(bad))]
    found = whiten(spark.createDataFrame(rows, SCHEMA).repartition(7), 4).collect()
    check(found, vectors, 4)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_jacobi_finds_small_eigenvalues(shift):
    rng = np.random.default_rng(5)
    d = 12
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    scale = np.logspace(0, -9, d)
    values, vectors = jacobi(np.diag(scale) + shift * np.eye(d))  # diagonal already
    assert np.allclose(values, np.sort(scale + shift)[::-1], rtol=1e-14)
    graded = np.diag(scale) @ (q @ np.diag(np.linspace(1, 2, d)) @ q.T) @ np.diag(scale)  # scaled positive definite
    values, vectors = jacobi(graded)
    import fractions

    exact = [[fractions.Fraction(float(v)) for v in row] for row in graded]
    det = fractions.Fraction(1)
    work = [row[:] for row in exact]
    for i in range(d):  # exact determinant by elimination
        det *= work[i][i]
        for j in range(i + 1, d):
            f = work[j][i] / work[i][i]
            work[j] = [a - f * b for a, b in zip(work[j], work[i])]
    assert math.isclose(math.prod(values), float(det), rel_tol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    assert list(values) == sorted(values, reverse=True)


def test_a_large_mean_costs_no_digits(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.integers(-8, 8, (60, 3)) / 256 + 40000).astype(np.float32).tolist()
    check(whiten(spark.createDataFrame([*enumerate(vectors)], SCHEMA), 3).collect(), vectors, 3)


def test_edge_cases(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [math.nan])], SCHEMA)).collect() == []
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], SCHEMA)).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.n == 1 and r.deviation == 0 for r in same)
    line = whiten(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(5)], SCHEMA)).collect()  # rank 1
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-12
    clash = spark.createDataFrame([(1, [1.0, 0.0], "a", 3.0, 9), (2, [0.0, 1.0], None, None, None)], SCHEMA + ", x string, whitened double, N int")
    found = whiten(clash)
    assert found.columns == ["vec_id", "x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {r.x for r in found.collect()} == {"a", None}
    wide = whiten(spark.createDataFrame([(i, [float(1e12 * i), 1.0]) for i in range(3)], SCHEMA), 1).collect()
    assert all(r.deviation == (3 * 256 * int(np.float32(1e12 * r.vec_id)) - sum(256 * int(np.float32(1e12 * i)) for i in range(3))) ** 2 for r in wide)
