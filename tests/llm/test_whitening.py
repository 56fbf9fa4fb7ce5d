"""Whitening against exact sums and a library eigen-solver, and odd vectors."""

import math

import numpy as np
import pytest

from docloom.llm import whitening as W


@pytest.mark.parametrize("n", [1, 2, 3, 9, 64])
def test_eigen_of_symmetric_matrices(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.ones((n, n)), np.diag(np.arange(n) % 3.0), np.zeros((n, n))):
        a = a @ a.T
        values, rows = W.eigen(a)
        scale = max(1.0, abs(a).max() * n)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * scale, rtol=0)
        assert np.allclose(rows @ rows.T, np.eye(n), atol=1e-13) and np.allclose(rows @ a @ rows.T, np.diag(values), atol=1e-13 * scale, rtol=0)


def test_moments_merge_to_those_of_all_rows():
    rng = np.random.default_rng(0)
    x = rng.integers(90_000, 110_000, size=(200, 5))
    parts = [W.Moments(5) for _ in range(4)]
    for m, rows in zip(parts, np.split(x, [0, 3, 120])):
        m.add(rows)
    for m in parts[1:]:
        parts[0].merge(m)
    assert parts[0].n == 200 and parts[0].sums == x.sum(axis=0).tolist()
    assert np.allclose(parts[0].mean, x.mean(axis=0)) and np.allclose(parts[0].covariance(), np.cov(x.T, bias=True))


def quantised(v):
    return [math.floor(1024 * float(c)) + 100_000 for c in v]


def test_against_plain_sums(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    x = {k: quantised(v) for k, v in vectors.items()}
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(r[j] for r in x.values()) for j in range(d)]
    centred = {k: np.array([(n * a - s) / n for a, s in zip(r, sums)]) for k, r in x.items()}
    cov = sum(np.outer(c, c) for c in centred.values()) / n
    values, vecs = np.linalg.eigh(cov)
    got = W.whiten(table.repartition(5)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert abs(r.explained - values[-r.component] / np.trace(cov)) < 1e-12
        want = centred[r.vec_id] @ vecs[:, -r.component] / math.sqrt(values[-r.component])
        assert abs(r.whitened * sign.setdefault(r.component, np.sign(r.whitened * want)) - want) < 1e-6


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(None, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0])]
    other = [(200, [5.0, 5.0]), (201, [5.0, 5.0]), (300, [1e300])]
    df = spark.createDataFrame([(*r, 1.0, 1) for r in good + bad + other], "vec_id long, embedding array<double>, n double, dim int").repartition(40)
    got = W.whiten(df).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got if r.n == 43) == sorted((v or -1, c) for v, _ in good for c in (1, 2, 3))
    assert all(abs(r.whitened) < 50 and r.identity_error < 1e-9 for r in got if r.n == 43)
    flat = [r for r in got if r.n == 2]
    assert {(r.vec_id, r.component, r.deviation, r.whitened, r.explained) for r in flat} == {(v, c, 0, None, None) for v in (200, 201) for c in (1, 2)}
    assert [(r.vec_id, r.n, r.deviation) for r in got if r.vec_id == 300] == [(300, 1, 0)]
    assert W.whiten(df.where("false")).collect() == []


def test_deviation_is_exact_or_null():
    m = W.Moments(2)
    m.add(np.array([[2**40, 3], [-(2**40), 3]]))
    w = W.Whitener(m, 8)
    assert w(np.array([[2**40, 3]]))[0] == [None]
    m = W.Moments(2)
    m.add(np.array([[2**29, 7], [-(2**29), 8]]))
    assert W.Whitener(m, 8)(np.array([[2**29, 7], [12345, 8]]))[0] == [(2 * 2**29) ** 2 + 1, 24690**2 + 1]
