"""Whitening against numpy's eigenvalues and exact sums."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formgrain.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA).repartition(3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=40), st.integers(-12, 12))
def test_counts_of_eigenvalues(entries, shift):
    d = max(1, math.isqrt(len(entries)))
    m = np.array(entries[:d * d], float).reshape(d, d)
    v = m + m.T
    e = np.linalg.eigvalsh(v)
    at = shift / 2 + 0.1234
    if np.abs(e - at).min() > 1e-9:
        assert whitening.below(v, at) == int((e < at).sum())


@pytest.mark.parametrize("values", [
    [5.0, 4.0, 3.0, 2.0, 1.0], [1.0, 1 - 1e-9, 1 - 2e-9, 0.5], [1.0, 1 - 1e-14, 0.5, 0.5, 0.5, 0.1], [3.0, 1e-7, 1e-9, 1e-12], [2.0] * 6, [1.0, 0, 0, 0, 0], [7.0],
])
def test_leading_pairs(values):
    q, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((len(values), len(values))))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    pairs = whitening.leading(v, 4)
    assert len(pairs) == min(4, len(values))
    assert np.allclose([e for e, _ in pairs], np.linalg.eigvalsh(v)[::-1][:4], rtol=0, atol=1e-14 * values[0] * len(values))
    axes = np.array([x for _, x in pairs])
    assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-13)
    assert max(np.linalg.norm(v @ x - e * x) for e, x in pairs) < 1e-14 * values[0] * len(values)


def usable(vector):
    return vector is not None and None not in vector and all(map(math.isfinite, vector))


def check(spark, rows):
    """Rows of the operator against sums over whole numbers and numpy's eigenvectors."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if usable(v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:4], q.T[::-1][:4]
    found = whitening.whitened_embeddings(frame(spark, rows)).collect()
    assert len(found) == len(good) * min(4, fit.shape[1])
    signs = {}
    expected = {}
    for i, x in good:
        for k in range(len(e)):
            w = float((np.array(x) - total / n) @ q[k] / np.sqrt(e[k]))
            deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, total, strict=True))
            expected.setdefault((i, k + 1), []).append((deviation, w, e[k] / np.trace(v)))
    seen = {}
    for r in found:
        seen.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened, r.explained))
        assert r.n == n and 0 <= r.identity_error < 1e-9
    assert seen.keys() == expected.keys()
    for key, ours in seen.items():
        theirs = expected[key]
        if key[1] not in signs and len(ours) == 1 and abs(ours[0][1]) > 1e-3:
            signs[key[1]] = np.sign(ours[0][1] * theirs[0][1])
    for key, ours in seen.items():
        turned = sorted((d, w * signs[key[1]], x) for d, w, x in ours)
        assert [t[0] for t in turned] == [t[0] for t in sorted(expected[key])]
        assert np.allclose(turned, sorted(expected[key]), rtol=1e-9, atol=1e-9)


def test_whitened_rows(spark):
    rng = np.random.default_rng(2)
    mixing = rng.standard_normal((9, 9)) * np.linspace(1, 3, 9)[:, None]
    rows = [(k, (rng.standard_normal(9) @ mixing).tolist()) for k in range(200)]
    rows += [(300 + k, rows[0][1]) for k in range(80)] + [(None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1])]
    rows += [(400, None), (401, [float("nan")] * 9), (402, [1.0] * 8 + [float("inf")]), (403, [None] + [0.0] * 8), (404, [-0.0] * 9), (405, [0.0] * 9), (406, [1e-9] * 9)]
    check(spark, rows)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(6)
    check(spark, [(k, (rng.standard_normal(3) * 4e4).tolist()) for k in range(50)])
    # Beyond double precision of products, and of a long in deviation.
    rows = whitening.whitened_embeddings(frame(spark, [(k, [float(k) * 1e14, 1.0]) for k in range(3)])).collect()
    assert {r.deviation for r in rows if r.vec_id == 0} == {None} and len(rows) == 6


def test_flat_and_missing_vectors(spark):
    assert whitening.whitened_embeddings(frame(spark, [])).collect() == []
    assert whitening.whitened_embeddings(frame(spark, [(1, None), (2, [float("nan"), 1.0]), (3, [])])).collect() == []
    rows = whitening.whitened_embeddings(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(rows)] == [
        (i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    rows = sorted(whitening.whitened_embeddings(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 2.0, 3.0])])).collect())
    assert [(r.vec_id, r.component, r.whitened) for r in rows] == [(1, 1, -1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]
    assert {r.identity_error for r in rows} == {0.0}
