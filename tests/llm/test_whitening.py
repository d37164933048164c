import numpy as np
import pytest

from telemill.llm import whitening as W


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T


CASES = {
    "spread": np.linspace(10, 0.1, 40), "clusters": np.r_[np.full(5, 3.0), np.full(5, 3.0 + 1e-12), np.linspace(1, 0, 30)], "equal": np.ones(12), "one": np.r_[1.0, np.zeros(9)],
    "wide": 10.0 ** np.linspace(8, -8, 20), "single": np.array([2.0]), "two": np.array([2.0, 1.0]),
}


@pytest.mark.parametrize("name", CASES)
def test_leading_components(name):
    v = spectrum(CASES[name])
    v = (v + v.T) / 2
    values, x = W.leading_components(v, 8)
    want = np.sort(CASES[name])[::-1][:8]
    scale = np.abs(CASES[name]).max()
    assert np.abs(values - want).max() < 1e-13 * scale * len(v)
    assert np.abs(x.T @ x - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs(v @ x - x * values).max() < 1e-12 * scale * len(v)


def test_diagonal_and_zero_matrices():
    for v in (np.diag([1.0, 5.0, 5.0, 0.0, 2.0]), np.zeros((4, 4)), np.diag([3.0, 3.0, 3.0])):
        values, x = W.leading_components(v, 3)
        assert np.allclose(values, np.sort(np.diag(v))[::-1][:3], atol=1e-12)
        assert np.abs(x.T @ x - np.eye(3)).max() < 1e-12
        assert np.abs(v @ x - x * values).max() < 1e-10


def test_sturm_counts():
    d, e, _ = W.tridiagonal(spectrum(CASES["spread"]))
    at = np.array([-1.0, 0.05, 3.0, 5.5, 11.0])
    assert W.sturm_counts(d, e, at).tolist() == [(CASES["spread"] < a).sum() for a in at]


def vectors(spark, n=400, d=20, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) @ np.diag(np.linspace(1, 0.2, d)) + rng.standard_normal(d)
    x[10:40] = x[10]
    rows = [(i, x[i].tolist()) for i in range(n)]
    bad = [(n, None), (n + 1, [float("nan")] * d), (n + 2, [None] * d), (n + 3, [float("inf")] * d), (n + 4, [1.0, 2.0]), (n + 5, [])]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>").repartition(4)
    return df.withColumns({c: W.F.lit("x") for c in ("id", "x", "v", "w", "n", "component")}), np.floor(1024 * x).astype(np.int64) + 100_000


def test_whitening_equals_numpy(spark):
    df, x = vectors(spark)
    rows = W.whiten(df).collect()
    n, s = len(x), x.sum(axis=0)
    assert len(rows) == n * 8
    values, components = np.linalg.eigh(np.cov(x.T, bias=True))
    values, components = values[::-1][:8], components[:, ::-1][:, :8]
    want = (x - s / n) @ components / np.sqrt(values)
    got = np.zeros((n, 8))
    for r in rows:
        got[r["id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == sum(int(v) ** 2 for v in n * x[r["id"]] - s)
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(np.cov(x.T, bias=True))) - 1) < 1e-9
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-8


def test_few_and_extreme_vectors(spark):
    df, _ = vectors(spark)
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.where("vec_id = 3")).count() == 0
    assert W.whiten(df.where("vec_id between 10 and 39")).count() == 0  # equal vectors
    two = W.whiten(df.where("vec_id < 2")).collect()
    assert sorted((r["id"], r["component"]) for r in two) == [(0, 1), (1, 1)]
    assert sorted(round(r["whitened"], 9) for r in two) == [-1.0, 1.0]
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, -7.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = W.whiten(huge).collect()
    assert {r["component"] for r in found} == {1} or len(found) == 8
    assert any(r["deviation"] is None for r in found)
