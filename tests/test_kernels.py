import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pairsieve.redundancy import kernels

from sequential import cone_residual, simplex_minimum


def _rows(seed, k, d, whole):
    rng = np.random.default_rng(seed)
    rows, y = rng.normal(size=(k, d)), rng.normal(size=d)
    return (np.round(rows), np.round(y)) if whole else (rows, y)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 6), st.integers(1, 5), st.booleans())
def test_nnls_equals_enumeration(seed, k, d, whole):
    rows, y = _rows(seed, k, d, whole)
    x, left = kernels.nnls(rows, y)
    assert (x >= 0).all()
    assert np.allclose(left, y - rows.T @ x)
    assert abs(left @ left - cone_residual(rows, y)) < 1e-8


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 5), st.integers(2, 4), st.booleans())
def test_simplex_equals_enumeration(seed, k, d, whole):
    rows, y = _rows(seed, k, d, whole)
    if seed % 5 == 0:
        y = np.full(d, y[0])  # every corner of the simplex ties
    got, w = kernels.simplex_minimum(y + 0.01, rows + 0.01)
    want = simplex_minimum(y, rows)
    assert (got is None) == (want is None)
    if want is not None:
        assert abs(got - 0.01 - want) < 1e-7
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(2, 6))
def test_certificates_are_sound(seed, k, d):
    rng = np.random.default_rng(seed)
    pool, targets = rng.normal(size=(k, d)), rng.normal(size=(7, d))
    pool /= np.linalg.norm(pool, axis=1, keepdims=True)
    limit = np.full(7, 0.05)
    for y, proven in zip(targets, kernels.certify(targets, pool, limit)):
        left = kernels.nnls(pool, y)[1]
        assert not proven or left @ left <= 0.05 + 1e-12
    if kernels.spans_everything(pool, 1e-6):
        for y in targets / np.linalg.norm(targets, axis=1, keepdims=True):
            assert np.linalg.norm(kernels.nnls(pool, y)[1]) <= 1e-6


def test_independent_rows_combine_like_a_sum():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 6))
    rows = np.vstack([rows, rows[:10], rng.normal(size=(4, 6))])
    keys = rng.permutation(len(rows))
    whole = set(keys[kernels.last_independent(keys, rows)])
    halves = []
    for part in (slice(0, 20), slice(20, None)):
        pick = kernels.last_independent(keys[part], rows[part])
        halves.append((keys[part][pick], rows[part][pick]))
    k, r = np.concatenate([h[0] for h in halves]), np.vstack([h[1] for h in halves])
    assert set(k[kernels.last_independent(k, r)]) == whole
    assert len(whole) == 6


def test_simplex_with_tied_costs_in_many_dimensions():
    rows = np.random.default_rng(0).normal(size=(250, 64)) * 0.2
    assert kernels.simplex_minimum(np.full(64, 0.01), rows + 0.01) == (None, None)
    aligned = rows * np.sign(rows.sum(axis=1))[:, None]
    value, w = kernels.simplex_minimum(np.full(64, 0.01), aligned + 0.01)
    assert abs(value - 0.01) < 1e-9 and (aligned @ w >= -0.01 - 1e-9).all()
