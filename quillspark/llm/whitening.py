"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The rows are centred by their exact sums and multiplied in turn by a direction v and, transposed, by the left
vector u that it gives; with full reorthogonalisation of both sides, the coefficients form a small bidiagonal matrix
whose singular value decomposition has the components and the deviations.

A left vector has as many entries as there are rows, so it is never stored: it is always the centred rows times
a short vector w, and a task makes its part of all of them anew.  Both products of a step and the coefficients of
reorthogonalisation therefore need one pass over the rows and bring a few numbers per dimension to the driver.
Nothing of a pass stays on executors, so one that is lost costs only its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.blocks import LONG, cells, finite, pack, summed, unpacked
from quillspark.operators.scale import materialize

COMPONENTS = 8
TINY = 1e-15  # of the largest singular value: what a residual may be
NOTHING = 1e-12  # of the largest coefficient: below it a direction is used up
LEAST = 1e-10  # of the largest singular value: deviations below it can't be told from rounding


@dataclass(frozen=True)
class Rows:
    """Stored blocks of integer vectors with their exact sums."""

    blocks: DataFrame
    n: int
    d: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def read(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Rows:
    known = finite(vectors, id_col, vector_col)
    d = known.agg(F.max(F.size("v"))).first()[0] or 0
    blocks = materialize(pack(known, d), "vectors")
    n = blocks.agg(F.sum(F.size("ids"))).first()[0] or 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in unpacked(batch, d):
                x = x.astype(np.int64)
                low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
                columns = [pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "low", "high"])

    parts = blocks.mapInArrow(add, "cell int, low long, high long").groupBy("cell")
    total = parts.agg(*[F.sum(F.col(c).cast("decimal(20,0)")) for c in ("low", "high")]).collect()
    sums = [0] * d
    for cell, low, high in total:
        sums[cell] = int(low) + (int(high) << 32)
    return Rows(blocks, n, d, sums)


def _products(rows: Rows, left: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """With X the centred rows and p = Xw: (X left)ᵀp, pᵀp and Xᵀp, of one pass."""
    mean, d, k = rows.mean, rows.d, left.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k + 1 + d)
        for batch in batches:
            for _, x in unpacked(batch, d):
                x = x - mean
                p = x @ w
                out[:k] += (x @ left).T @ p
                out[k] += p @ p
                out[k + 1 :] += x.T @ p
        yield cells(out)

    out = summed(rows.blocks.select("ids", "x").mapInArrow(run, "cell int, value double"), k + 1 + d)
    return out[:k], float(out[k]), out[k + 1 :]


def _against(r: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for basis in bases:
            r = r - basis @ (basis.T @ r)
    return r


@dataclass
class Bidiagonal:
    """Right vectors v, short vectors w of the left ones, Xᵀu of each, and the coefficients."""

    d: int
    v: list[np.ndarray] = field(default_factory=list)
    w: list[np.ndarray] = field(default_factory=list)
    z: list[np.ndarray] = field(default_factory=list)
    alpha: list[float] = field(default_factory=list)
    beta: list[float] = field(default_factory=list)  # beta[k] joins step k and k + 1

    def columns(self, what: list[np.ndarray]) -> np.ndarray:
        return np.array(what).T if what else np.zeros((self.d, 0))

    def solve(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right vectors and residuals of the small matrix."""
        k = len(self.alpha)
        small = np.diag(self.alpha) + np.diag(self.beta[: k - 1], 1)
        p, values, q = np.linalg.svd(small)
        return values, self.columns(self.v) @ q.T, self.beta[k - 1] * np.abs(p[-1])


def _bidiagonalise(rows: Rows, found: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Singular values and right vectors orthogonal to ``found``: the ``most`` largest, and whether none are left out.

    It ends when these have converged or all directions are used.  Where a direction leads nowhere, another one
    starts, drawn from a fixed seed.
    """
    state, rng = Bidiagonal(rows.d), np.random.default_rng(found.shape[1])
    left = rows.d - found.shape[1]
    r, scale = rng.standard_normal(rows.d), 0.0
    beta = 0.0
    while len(state.v) < left:
        r = _against(r, found, state.columns(state.v))
        if not np.linalg.norm(r):
            break
        v = r / np.linalg.norm(r)
        w = v - beta * state.w[-1] if beta else v
        h, square, z = _products(rows, state.columns(state.w), w)
        lost = h @ h
        for again in range(2):  # u is made orthogonal to the ones before
            if again:
                if lost <= 0.01 * square:  # what rounding can spoil is too little to matter
                    break
                h, square, z = _products(rows, state.columns(state.w), w)
            w = w - state.columns(state.w) @ h
            z = z - state.columns(state.z) @ h
            square -= h @ h
        alpha = np.sqrt(max(square, 0.0))
        scale = max(scale, alpha)
        used_up = alpha <= NOTHING * scale
        state.v.append(v)
        state.alpha.append(0.0 if used_up else alpha)
        state.w.append(np.zeros(rows.d) if used_up else w / alpha)
        state.z.append(np.zeros(rows.d) if used_up else z / alpha)
        r = _against(state.z[-1] - state.alpha[-1] * v, found, state.columns(state.v))
        beta = float(np.linalg.norm(r))
        if beta <= NOTHING * scale:
            beta, r = 0.0, rng.standard_normal(rows.d)
        state.beta.append(beta)
        if beta and len(state.v) > most:
            values, right, residual = state.solve()
            if (residual[:most] <= TINY * values[0]).all():
                return values[:most], right[:, :most], False
    if not state.v:
        return np.zeros(0), np.zeros((rows.d, 0)), True
    values, right, _ = state.solve()
    return values[:most], right[:, :most], True


def components(rows: Rows, most: int = COMPONENTS) -> np.ndarray:
    """Unit eigenvectors of the covariance as columns, by falling eigenvalue, at most ``most`` of value above zero.

    One starting direction finds one vector for each different value, so what is orthogonal to those found is
    searched again until nothing larger is left.
    """
    values, right, whole = _bidiagonalise(rows, np.zeros((rows.d, 0)), min(most, rows.d))
    while not whole:
        more, others, whole = _bidiagonalise(rows, right, min(most, rows.d))
        larger = more > values[-1] * (1 + 1e-9) if len(values) == most else more >= 0
        if not larger.any():
            break
        values, right = np.concatenate([values, more[larger]]), np.hstack([right, others[:, larger]])
        order = np.argsort(-values, kind="stable")[:most]
        values, right = values[order], right[:, order]
    kept = values > LEAST * values[0] if len(values) else np.zeros(0, bool)
    return right[:, kept]


def _second_moments(rows: Rows, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance of the rows' projections on ``c``, and the trace of the rows' own."""
    mean, d, k = rows.mean, rows.d, c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * k + k + 1)
        for batch in batches:
            for _, x in unpacked(batch, d):
                x = x - mean
                p = x @ c
                out[: k * k] += (p.T @ p).ravel()
                out[k * k : -1] += p.sum(0)
                out[-1] += np.einsum("ij,ij->", x, x)
        yield cells(out)

    out = summed(rows.blocks.select("ids", "x").mapInArrow(run, "cell int, value double"), k * k + k + 1) / rows.n
    middle = out[k * k : -1]
    return out[: k * k].reshape(k, k) - np.outer(middle, middle), float(out[-1])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Per row the sum over dimensions of (n*x - S)^2, exactly."""
    x = x.astype(np.int64)
    most, largest, d = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))), max(map(abs, sums), default=0), len(sums)
    if (n * most + largest) ** 2 * d < LONG:
        away = n * x - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", away, away).tolist()
    if max(most, largest) * most * d < LONG:
        squares, mixed = np.einsum("ij,ij->i", x, x).tolist(), (x @ np.array(sums, np.int64)).tolist()
        own = sum(s * s for s in sums)
        return [n * n * a - 2 * n * b + own for a, b in zip(squares, mixed)]
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: deviation from the mean, whitened value, share of the variance.

    Vectors that are null or hold null, NaN or infinite entries are left out.  Shorter vectors count as ending in
    zeros, entries beyond the range of a long after scaling as its ends.  A null id is given back as null, repeated rows
    count each time.  Where the rows span fewer directions than ``most`` there are fewer components, none when all
    vectors are equal or there are none.  ``deviation`` is null where it is beyond a long; ``deviation_text`` holds its
    digits then.  The shift by 100000 in the contract cancels in every result, so it is not stored.
    """
    rows = read(vectors, id_col, vector_col)
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType
    kind = T.StructType().add(id_col, id_type).add("component", "integer").add("n", "long").add("deviation", "long")
    kind = kind.add("whitened", "double").add("explained", "double").add("identity_error", "double").add("deviation_text", "string")
    c = components(rows, most) if rows.n and rows.d else np.zeros((rows.d, 0))
    k = c.shape[1]
    if not k:
        return spark.createDataFrame([], kind)
    covariance, trace = _second_moments(rows, c)
    e = np.diag(covariance)
    error = float(np.abs(covariance / np.sqrt(np.outer(e, e)) - np.eye(k)).max())
    mean, n, d, sums, scaled, share = rows.mean, rows.n, rows.d, rows.sums, c / np.sqrt(e), e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in unpacked(batch, d):
                exact = deviations(x, n, sums)
                m, fits = len(exact), [v < LONG for v in exact]
                short = pa.array([v if f else None for v, f in zip(exact, fits)], pa.int64())
                digits = pa.array([None if f else str(v) for v, f in zip(exact, fits)], pa.string())
                row = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    ids.take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    short.take(row), pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)), digits.take(row),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return rows.blocks.select("ids", "x").mapInArrow(run, kind)
