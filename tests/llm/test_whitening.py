"""Whitening against a dense eigensolver and exact whole-number sums."""

import numpy as np
import pytest

from filingrisk.llm import catalog, whitening


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((40, 40))
    a = a + a.T
    right, shifts = rng.standard_normal((40, 3)), np.array([0.3, -2.0, 5.0])
    made = whitening.minres(lambda b: a @ b, shifts, right, lambda b: b, steps=200, tolerance=1e-12)
    for j in range(3):
        assert np.allclose(made[:, j], np.linalg.solve(a - shifts[j] * np.eye(40), right[:, j]), atol=1e-7)


@pytest.mark.parametrize("shape", [(400, 1), (60, 3), (5, 40), (300, 12), (900, 200)])
def test_eigenpairs(shape):
    rng = np.random.default_rng(shape[1])
    x = rng.standard_normal(shape) * np.linspace(1, 3, shape[1]) * 100
    c = x - x.mean(axis=0)
    v = c.T @ c / len(c)
    values, vectors = whitening.jacobi_davidson(lambda b: c.T @ (c @ b) / len(c), shape[1], 8)
    want = np.linalg.eigvalsh(v)[::-1][: len(values)]
    assert len(values) == min(8, shape[1]) and np.allclose(values, want, rtol=0, atol=1e-13 * want[0])
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-13 * want[0]
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_equal_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((30, 30)))
    v = (q * np.repeat([9.0, 4.0, 1.0], [5, 10, 15])) @ q.T
    values, vectors = whitening.jacobi_davidson(lambda b: v @ b, 30, 8)
    assert np.allclose(values, [9] * 5 + [4] * 3) and np.allclose(v @ vectors, vectors * values)


def plain(rows):
    """(vec_id, component) -> what the contract asks, by dense means."""
    x = np.array([[int(np.floor(1024 * float(v))) + 100_000 for v in e] for _, e in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    c = (n * x - sums).astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, deviation, c, values, vectors


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, c, values, vectors = plain(rows)
    got = {(r.vec_id, r.component): r for r in catalog.QUERIES["op12_embedding_whitening"](spark, folder).collect()}
    assert set(got) == {(i, k) for i, _ in rows for k in range(1, 9)}
    for k in range(1, 9):
        made = np.array([got[i, k].whitened for i, _ in rows])
        want = c @ vectors[:, k - 1] / np.sqrt(values[k - 1])
        assert min(np.abs(made - want).max(), np.abs(made + want).max()) < 1e-9
        assert abs(got[rows[0][0], k].explained / (values[k - 1] / values.sum()) - 1) < 1e-10
    for at, (i, _) in enumerate(rows):
        assert got[i, 1].deviation == deviation[at] and got[i, 1].n == n and got[i, 1].identity_error < 1e-9


def test_edges(spark):
    schema = "vec_id long, embedding array<double>, x string, dim int, n double"
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(6).tolist()) for i in range(30)] + [(3, [0.5] * 6), (3, [0.5] * 6), (None, [0.25] * 6)]
    bad = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (92, [nan] * 6), (93, [inf] + [0.0] * 5), (94, []), (95, [1.0] * 5)]
    table = spark.createDataFrame([(i, e, "clash", 1, 2.0) for i, e in good + bad], schema)
    rows = whitening.prepare(table)
    model = whitening.fit(rows)
    got = whitening.whiten(rows, model, whitening.identity_error(rows, model)).collect()
    n, deviation, _, values, _ = plain(good)
    assert len(got) == 6 * len(good) and model.n == n and np.allclose(model.values, values)
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(deviation.tolist())
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9

    for some in (table.where("false"), table.where("vec_id >= 90 and vec_id <> 95"), spark.createDataFrame([(i, [1.0, 2.0], "", 0, 0.0) for i in range(4)], schema)):
        rows = whitening.prepare(some)
        model = whitening.fit(rows)
        assert not len(model.values) and whitening.identity_error(rows, model) is None and whitening.whiten(rows, model).count() == 0
    # On one line: a single component.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0 * i], "", 0, 0.0) for i in range(4)], schema)
    rows = whitening.prepare(line)
    model = whitening.fit(rows)
    assert len(model.values) == 1 and abs(model.values[0] / model.trace - 1) < 1e-12


def test_deviations_beyond_a_long():
    x = np.array([[100_000 + 4_000_000, 100_000], [100_000 - 4_000_000, 100_001]], dtype=np.int64)
    n = 1 << 20
    sums = np.array([100_000 * n, 100_000 * n], dtype=np.int64)
    assert whitening.squared_deviations(x, n, sums) == [(n * 4_000_000) ** 2, (n * 4_000_000) ** 2 + n**2]
