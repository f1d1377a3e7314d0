"""Whitening against an eigendecomposition of the whole covariance."""

import math

import numpy as np
import pytest

from quillspark.llm import whitening as M

VECTORS = "vec_id long, embedding array<double>, label int"


def whole(rows):
    """n, deviations, eigenvalues and vectors by falling value, and centred rows."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    away = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array(x, dtype=float) - np.array(sums, dtype=float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return away, values[::-1], vectors[:, ::-1], centred


def run(spark, x, most=8):
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], VECTORS).repartition(3)
    return M.whiten(df, most=most).orderBy("vec_id", "component").collect()


@pytest.mark.parametrize("shape", ["flat", "steep", "copies", "low_rank", "few_rows", "twins"])
def test_equals_eigendecomposition(spark, shape):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 20))
    if shape == "steep":
        x = x * 3.0 ** -np.arange(20) @ np.linalg.qr(rng.standard_normal((20, 20)))[0] * 1000
    if shape == "copies":
        x[::3] = x[0]
    if shape == "low_rank":
        x = np.round(x[:, :3] * 50) @ rng.integers(-3, 4, (3, 20)) / 1024
    if shape == "few_rows":
        x = x[:5]
    if shape == "twins":  # each variance twice
        x = np.vstack([s * np.eye(20)[i] * (5 + i // 2) for i in range(20) for s in (-1, 1)])
    got = run(spark, x.tolist())
    away, values, vectors, centred = whole(x.tolist())
    k = min(8, int((values > 1e-9 * values[0]).sum()))
    assert [(r.vec_id, r.component) for r in got] == [(i, c + 1) for i in range(len(x)) for c in range(k)]
    assert [r.deviation for r in got[::k]] == away and {r.n for r in got} == {len(x)}
    white = np.array([r.whitened for r in got]).reshape(-1, k)
    share = np.array([r.explained for r in got[:k]])
    assert np.abs(share / (values[:k] / values.sum()) - 1).max() < 1e-9 and got[0].identity_error < 1e-6
    assert np.abs(white.T @ white / len(x) - np.eye(k)).max() < 1e-6
    if shape != "twins":  # the components themselves are only known where values differ
        want = centred @ vectors[:, :k] / np.sqrt(values[:k])
        assert np.abs(white - want * np.sign((white * want).sum(0))).max() < 1e-8


def test_converges_before_all_directions_are_used(spark):
    """A steep spectrum ends early, and what is orthogonal to the result is searched once more."""
    rng = np.random.default_rng(7)
    x = (rng.standard_normal((200, 60)) * 0.5 ** np.arange(60)) @ np.linalg.qr(rng.standard_normal((60, 60)))[0] * 1e6
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    rows = M.read(df)
    values, right, all_used = M._bidiagonalise(rows, np.zeros((60, 0)), 4)
    assert not all_used and len(values) == 4
    _, _, vectors, _ = whole(x.tolist())
    assert np.abs(np.abs((M.components(rows, 4) * vectors[:, :4]).sum(0)) - 1).max() < 1e-12


def test_exact_deviations_of_any_size():
    for size in (10, 10**6, 10**12):
        x = np.random.default_rng(8).integers(-size, size, (7, 4))
        for n in (7, 10**9):
            sums = [int(s) * (n // 7) for s in x.sum(0)]
            want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
            assert M.deviations(x, n, sums) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 0), (1, [3.0], 0), (2, [], 0), (3, None, 0), (4, [nan, 1.0], 0), (5, [-inf, 1.0], 0),
        (6, [None, 1.0], 0), (None, [9.0, 9.0], 0), (7, [1.0, 2.0], None), (7, [1.0, 2.0], 0),
    ]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'clash' as component", "'clash' as n", "'clash' as part")
    got = M.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted(
        (i is None, i or 0, c) for i in (0, 1, 2, None, 7, 7) for c in (1, 2)
    )
    away, *_ = whole([[1, 2], [3, 0], [0, 0], [9, 9], [1, 2], [1, 2]])
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(away)
    assert M.whiten(df.filter("false")).count() == 0 and M.whiten(df.filter("vec_id = 7")).count() == 0
    huge = spark.createDataFrame([(0, [1e300], 0), (1, [-1e300], 0), (2, [0.0], 0)], VECTORS)
    top = M.whiten(huge).filter("vec_id = 0").first()
    assert top.deviation is None and int(top.deviation_text) == (3 * (2**63 - 1) + 1) ** 2
