"""Exact top-k inner products against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import inner_top as M

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    """Of (id, integer vector) rows, with Python integers."""
    out = []
    for q, x in rows:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in rows if c != q)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def ints(v):
    return [math.floor(1024 * float(np.float32(c))) for c in v]


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(4)
    return sorted(map(tuple, M.search(df, F.col("vec_id") % 100 == 0, k).collect()))


@pytest.mark.parametrize("shape", ["flat", "long_tail", "copies", "low_rank"])
def test_equals_brute_force(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 12))
    if shape == "long_tail":
        x *= rng.pareto(1.5, (900, 1)) + 0.01
    if shape == "copies":  # a third of all rows, the queries among them
        x[::3] = x[0]
    if shape == "low_rank":
        x = x[:, :2] @ rng.standard_normal((2, 12))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    assert run(spark, rows) == brute([(i, ints(v)) for i, v in rows], 10)


def test_groups_of_queries_and_small_blocks(spark, monkeypatch):
    """Several groups pass one after the other; with fewer rows than k all are returned."""
    monkeypatch.setattr(M, "GROUP", 2)
    rng = np.random.default_rng(4)
    rows = [(100 * i, rng.standard_normal(5).tolist()) for i in range(9)]
    assert run(spark, rows) == brute([(i, ints(v)) for i, v in rows], 10)
    assert len(run(spark, rows)) == 9 * 8


def test_long_lengths_end_tasks_early():
    """Blocks behind the long vectors leave no pair, and bounds never lose one."""
    rng = np.random.default_rng(5)
    q, c = rng.integers(-900, 900, (40, 16)), rng.integers(-900, 900, (300, 16))
    axes, ends = np.linalg.eigh((c.T @ c).astype(float))[1][:, ::-1], [4, 10]
    score = q @ c.T
    floor = np.sort(score, axis=1)[:, -5].astype(float)
    i, j = M._candidates(M._turn(q, axes, ends), M._turn(c, axes, ends), floor, ends)
    assert set(zip(*np.nonzero(score >= floor[:, None]))) <= set(zip(i, j)) and len(i) < score.size / 4


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 0), (1, [3.0], 0), (2, [], 0), (3, None, 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0),
        (6, [None, 1.0], 0), (None, [9.0, 9.0], 0), (7, [1.0, 2.0], 0), (7, [1.0, 2.0], 0), (100, [-1.0, 0.5], None),
        (200, None, 0),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("rank", F.lit("clash"))
    got = sorted(map(tuple, M.search(df, F.col("vec_id") % 100 == 0).collect()))
    one = 1024 * 1024
    assert got == [
        (0, 1, 7, 5 * one), (0, 2, 7, 5 * one), (0, 3, 1, 3 * one), (0, 4, 2, 0), (0, 5, 100, 0),
        (100, 1, 0, 0), (100, 2, 2, 0), (100, 3, 7, 0), (100, 4, 7, 0), (100, 5, 1, -3 * one),
    ]
    assert M.search(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert M.search(df.filter("vec_id = 2"), F.lit(True)).count() == 0


def test_very_long_components(spark):
    """Beyond a double's whole numbers scores stay exact; beyond a long they are its ends."""
    rows = [(0, [3e5, 1.0]), (1, [3e5, 1.0]), (2, [3e5, 2.0]), (3, [1e30, 0.0]), (4, [-1e30, 0.0])]
    got = run(spark, rows)
    want = [(0, ints(v)) for _, v in rows[:1]] + [(i, ints(v)) for i, v in rows[1:]]
    held = [(q, r, c, max(-(2**63), min(s, 2**63 - 1))) for q, r, c, s in brute(want, 10)]
    assert got == held
