"""Whitening against a dense eigensolver and exact integers."""

import math

import numpy as np
import pytest

from anomalens.llm import queries
from anomalens.llm import whitening as W

R = np.random.default_rng(3)


def _orthogonal(n):
    return np.linalg.qr(R.standard_normal((n, n)))[0]


CASES = {
    "one": R.standard_normal((1, 7)), "column": R.standard_normal((9, 1)), "small": R.standard_normal((12, 3)),
    "wide": R.standard_normal((3, 10)), "tall": R.standard_normal((400, 64)), "zero": np.zeros((5, 6)), "eye": np.eye(9),
    "diagonal": np.diag([1.0, 3, 2, 0, 5, 5]), "copies": np.hstack([R.standard_normal((40, 5))] * 3),
    "cluster": _orthogonal(30) @ np.diag([5.0] * 6 + [1.0] * 24) @ _orthogonal(30),
    "near": _orthogonal(30) @ np.diag([5, 5 - 1e-9, 5 - 2e-9, 5 - 1e-13, 5] + [1e-3] * 25) @ _orthogonal(30),
    "graded": _orthogonal(30) @ np.diag(10.0 ** -np.arange(30)) @ _orthogonal(30),
}


@pytest.mark.parametrize("name", CASES)
def test_solver(name):
    a = CASES[name]
    d = a.shape[1]
    values, z = W.principal(np.linalg.qr(a, mode="r"), 4)
    want = np.zeros(d)
    s = np.linalg.svd(a, compute_uv=False)
    want[:len(s)] = s ** 2
    top = max(want[0], 1e-300)
    assert len(values) == min(4, d) and np.abs(values - want[:len(values)]).max() <= 1e-13 * top
    assert np.abs(z.T @ z - np.eye(len(values))).max() < 1e-13
    assert np.abs(a.T @ (a @ z) - z * values).max() <= 1e-12 * top


def test_small_values_are_accurate():
    # A bidiagonal matrix fixes even its least singular values to high relative accuracy.
    d = 10.0 ** -np.arange(0, 24, 2.0)
    got = W.singular_squares(d, np.zeros(len(d) - 1))
    assert np.abs(got / np.sort(d ** 2)[::-1] - 1).max() < 1e-14
    lower = np.full(11, 1e-3) * d[1:]
    got = W.singular_squares(d, lower)
    assert math.isclose(float(np.prod(np.sqrt(got))), float(np.prod(d)), rel_tol=1e-12)


def test_all_singular_values():
    r = np.linalg.qr(R.standard_normal((300, 50)), mode="r")
    d, e, _ = W.bidiagonal(r)
    assert np.abs(np.sqrt(W.singular_squares(d, e)) - np.linalg.svd(r, compute_uv=False)).max() < 1e-12


def brute(rows, k=4):
    """{(id, component): ...} for vectors of one length, and n, S, e, trace."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in good}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, s = len(fit), [sum(c) for c in fit.T]
    dense = np.array(fit, float) - np.array(s, float) / n
    e, vec = np.linalg.eigh(dense.T @ dense / n)
    order = np.argsort(-e)
    e, vec = e[order][:k], vec[:, order][:, :k]
    out = {i: (n, sum((n * a - b) ** 2 for a, b in zip(v, s)),
               (np.array(v, float) - np.array(s, float) / n) @ vec / np.sqrt(e)) for i, v in x.items()}
    return out, e, float(np.trace(dense.T @ dense / n))


def _agree(got, rows):
    want, e, trace = brute(rows)
    by = {(r.vec_id, r.component): r for r in got}
    assert set(by) == {(i, c + 1) for i in want for c in range(len(e))}
    for c in range(len(e)):
        ids = list(want)
        mine, true = np.array([by[i, c + 1].whitened for i in ids]), np.array([want[i][2][c] for i in ids])
        assert min(np.abs(mine - true).max(), np.abs(mine + true).max()) < 1e-8
        assert all(abs(by[i, c + 1].explained / (e[c] / trace) - 1) < 1e-10 for i in ids)
    for i, (n, deviation, _) in want.items():
        assert by[i, 1].n == n and by[i, 1].deviation == deviation and by[i, 1].identity_error < 1e-9


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, label int")


def test_query(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(i, (r.standard_normal(12) * np.arange(1, 13)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i % 7][1]) for i in range(60)]  # copies
    rows += [(900, None), (901, [float("nan")] * 12), (902, [None] * 12), (903, [float("inf")] + [0.0] * 11), (904, [-0.0] * 12)]
    _vectors(spark, [(i, v, "x", 1) for i, v in rows]).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_embedding_whitening(spark, str(tmp_path)).collect()
    _agree(got, rows)


def test_rounds_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    r = np.random.default_rng(6)
    rows = [(i, r.standard_normal(5).tolist()) for i in range(200)]
    _agree(W.whiten(_vectors(spark, [(i, v, "x", 1) for i, v in rows])).collect(), rows)


def test_edges(spark):
    assert W.whiten(_vectors(spark, [])).count() == 0
    assert W.whiten(_vectors(spark, [(1, None, "", 0), (2, [], "", 0)])).count() == 0
    got = W.whiten(_vectors(spark, [(None, [1.0, 2.0], "", 0), (7, [1.0, 2.0], "", 0), (7, [1.0, 2.0], "", 0)])).collect()
    assert len(got) == 6 and all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.n == 1
                                 and r.deviation == 0 for r in got)
    # Two lengths are two fits.
    r = np.random.default_rng(8)
    rows = [(i, r.standard_normal(3 + i % 2).tolist()) for i in range(80)]
    got = W.whiten(_vectors(spark, [(i, v, "", 0) for i, v in rows])).collect()
    _agree([g for g in got if g.vec_id % 2 == 0], [x for x in rows if x[0] % 2 == 0])
    _agree([g for g in got if g.vec_id % 2], [x for x in rows if x[0] % 2])


def test_deviation_beyond_a_long():
    w = W.Whitening(1 << 22, (0,) * 4, np.eye(4), np.ones(4), 4.0)
    x = np.array([[1 << 20] * 4], np.int64)
    assert W._deviations(x, w) == [4 * (1 << 42) ** 2 * 1]
