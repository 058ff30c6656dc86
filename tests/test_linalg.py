import numpy as np
import pytest

from quillmere.functions.frames import frame_of, matrix
from quillmere.operators.linalg import PrincipalComponents, canonical_signs, leading_eigen, symmetric_eigen

RNG = np.random.default_rng(7)
X = RNG.normal(0, 1, (120, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) + RNG.normal(0, 3, 6)


def frame(spark, x):
    return frame_of(spark, np.arange(len(x)), x).repartition(3)


@pytest.mark.parametrize("whiten", [False, True])
def test_matches_singular_values(spark, whiten):
    p = PrincipalComponents.fit_count(frame(spark, X), 6, whiten)
    c = X - X.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    vt = canonical_signs(vt.T).T
    np.testing.assert_allclose(p.mean, X.mean(0), atol=1e-10)
    np.testing.assert_allclose(p.explained_variance, s**2 / (len(X) - 1), atol=1e-9)
    np.testing.assert_allclose(p.components, vt, atol=1e-8)
    ids, z = matrix(p.transform(frame(spark, X)))
    np.testing.assert_allclose(z, c @ vt.T / (s / np.sqrt(len(X) - 1) if whiten else 1), atol=1e-8)
    np.testing.assert_allclose(matrix(p.inverse_transform(p.transform(frame(spark, X))))[1], X, atol=1e-9)


def test_threshold_and_degenerate(spark):
    i = np.arange(40.0)
    line = np.column_stack([i, 2 * i, np.full(40, 5)])
    assert PrincipalComponents.fit(frame(spark, line), 1.0).count == 1
    assert PrincipalComponents.fit_count(frame(spark, line), 3, False).count == 3
    assert PrincipalComponents.fit(frame(spark, X), 0.5).count < PrincipalComponents.fit(frame(spark, X), 0.999).count
    assert PrincipalComponents.fit(frame(spark, np.ones((5, 2))), whiten=False).explained_variance_ratio == 1.0
    for bad in (0, -1):
        with pytest.raises(ValueError):
            PrincipalComponents.fit_count(frame(spark, X), bad)
    with pytest.raises(ValueError):
        PrincipalComponents.fit(frame(spark, X[:1]))


def test_symmetric_eigen():
    v, q = symmetric_eigen(np.array([[2.0, 1], [1, 2]]))
    np.testing.assert_allclose(v, [3, 1])
    np.testing.assert_allclose(q[:, 0], [0.5**0.5] * 2)
    with pytest.raises(ValueError):
        symmetric_eigen(np.ones((2, 3)))


def test_leading_eigen_of_a_known_operator():
    u = np.array([1.0, 2, 3, 4])[:, None]
    q = np.eye(4) - 2 * u @ u.T / (u.T @ u)
    a = q @ np.diag([4.0, 3, 2, 1]) @ q.T
    values, vectors, steps, done = leading_eigen(4, lambda b: a @ b, 2)
    np.testing.assert_allclose(values, [4, 3], atol=1e-9)
    assert done and steps == 1
    np.testing.assert_allclose(np.abs((q[:, :2] * vectors).sum(axis=0)), 1, atol=1e-9)


def test_leading_eigen_of_a_large_operator():
    b = RNG.normal(0, 1, (200, 200))
    a = b @ b.T
    values, vectors, _, done = leading_eigen(200, lambda x: a @ x, 5)
    assert done
    np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1][:5], rtol=1e-9)
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-8 * values[0] * 1.01
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(5), atol=1e-10)
    assert not leading_eigen(200, lambda x: a @ x, 5, max_iterations=1)[3]


@pytest.mark.parametrize("bad", [dict(size=0, count=1), dict(size=3, count=0), dict(size=3, count=4), dict(size=3, count=1, tolerance=0), dict(size=3, count=1, max_iterations=0)])
def test_leading_eigen_refusals(bad):
    with pytest.raises(ValueError):
        leading_eigen(multiply=lambda b: b, **bad)
    with pytest.raises(ValueError):
        leading_eigen(3, lambda b: b[:1], 1)
