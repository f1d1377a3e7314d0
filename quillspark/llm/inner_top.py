"""Exact top-k inner products by length order, rotated partial sums and Cauchy-Schwarz bounds.

Vectors are stored once as blocks in order of falling length.  The rotation that the singular value decomposition of all
vectors gives puts most of their length into the first coordinates, so a partial sum over these and the product
of the two remaining lengths bound an inner product well.  A task goes through its blocks from the longest
vectors on: queries whose kth best score no vector of a block can reach are done, the other pairs are ruled out head
by head, and what is left is scored in integers.  Scores start from those of the longest vectors of all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillspark.llm.blocks import LONG, cells, finite, in_groups, pack, squared_length, summed, unpacked
from quillspark.operators.scale import materialize, shared_dir

TOP = 10
HEADS = (0.5, 0.85)  # shares of the squared length that the partial sums cover
TOGETHER = 512  # queries compared with a block at a time
GROUP = 16_384  # queries that pass through the driver and travel with the tasks at a time
SEEDS = 2  # blocks of the longest vectors that give the first scores
PAIRS = 65_536  # pairs scored at a time
FEW = 0.05  # of all pairs: fewer are looked at one by one
SLACK = 1e-9  # of the product of two lengths, for rounding in the rotated sums


def _moments(blocks: DataFrame, d: int) -> np.ndarray:
    """Sum of x xᵀ over all vectors."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, d))
        for batch in batches:
            for _, x in unpacked(batch, d):
                x = x.astype(np.float64)
                out += x.T @ x
        yield cells(out[upper])

    flat = summed(blocks.select("ids", "x").mapInArrow(run, "cell int, value double"), len(upper[0]))
    out = np.zeros((d, d))
    out[upper] = flat
    return out + np.triu(out, 1).T


def rotation(blocks: DataFrame, d: int) -> tuple[np.ndarray, list[int]]:
    """Right singular vectors of all vectors, the largest first, and where the heads end."""
    values, vectors = np.linalg.eigh(_moments(blocks, d))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    ends = sorted({min(d, int(np.searchsorted(share, h)) + 1) for h in HEADS} - {d})
    return np.ascontiguousarray(vectors), ends


@dataclass(frozen=True)
class Turned:
    """Integer vectors beside their rotated form; ``rest`` has the lengths beyond each head, ``length`` the whole."""

    x: np.ndarray
    turned: np.ndarray
    rest: list[np.ndarray]
    length: np.ndarray

    def __getitem__(self, rows) -> Turned:
        return Turned(self.x[rows], self.turned[rows], [r[rows] for r in self.rest], self.length[rows])


def _turn(x: np.ndarray, axes: np.ndarray, ends: list[int]) -> Turned:
    turned = x.astype(np.float64) @ axes
    squares = np.cumsum(turned[:, ::-1] ** 2, axis=1)[:, ::-1]  # of each coordinate and the ones behind it
    rest = [np.sqrt(squares[:, e]) for e in ends]
    return Turned(x, turned, rest, np.sqrt(squares[:, 0]) if x.shape[1] else np.zeros(len(x)))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows in integers; beyond a long its nearest end."""
    most = max((abs(int(v)) for m in (q, c) for v in (m.max(initial=0), m.min(initial=0))), default=0)
    bound = most * most * max(q.shape[1], 1)
    if bound < 2**53:
        return np.einsum("ij,ij->i", q.astype(np.float64), c.astype(np.float64)).astype(np.int64)
    if bound < LONG:
        return np.einsum("ij,ij->i", q.astype(np.int64), c.astype(np.int64))
    whole = (sum(a * b for a, b in zip(x, y)) for x, y in zip(q.tolist(), c.tolist()))
    return np.array([min(max(v, -LONG), LONG - 1) for v in whole], np.int64)


def _candidates(q: Turned, c: Turned, floor: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose inner product the bounds leave at ``floor`` or above."""
    reach = np.outer(q.length, c.length)
    least = floor[:, None] - SLACK * reach - 1e-6
    if not ends:
        return np.nonzero(reach >= least)
    a, sums = 0, np.zeros(reach.shape)
    open_pairs = None
    for e, rq, rc in zip(ends, q.rest, c.rest):
        if open_pairs is None:
            sums += q.turned[:, a:e] @ c.turned[:, a:e].T
            i, j = np.nonzero(sums + np.outer(rq, rc) >= least)
            if len(i) <= FEW * reach.size:
                open_pairs = sums[i, j]
        else:
            open_pairs = open_pairs + np.einsum("ij,ij->i", q.turned[i, a:e], c.turned[j, a:e])
            keep = open_pairs + rq[i] * rc[j] >= least[i, j]
            i, j, open_pairs = i[keep], j[keep], open_pairs[keep]
        a = e
    return i, j


def _floor(score: np.ndarray) -> np.ndarray:
    """Scores as bounds; the lowest long stands for all below it too."""
    return np.where(score == -LONG, -np.inf, score.astype(np.float64))


class _Best:
    """The k best candidates of each query so far, by falling score, then by id."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = (np.concatenate(p) for p in ((self.row, row), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, row))  # ~s falls as s rises, without overflow
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]
        last = np.arange(len(row)) - first == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], _floor(score[last]))


def _search(blocks: DataFrame, d: int, queries: tuple, axes: np.ndarray, ends: list[int], k: int) -> DataFrame:
    """The k best of each task's vectors for each query, those below the query's floor left out."""
    numbers, own, vectors, floor = queries
    sent = blocks.sparkSession.sparkContext.broadcast((own, vectors, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors, floor = sent.value
        starts = range(0, len(own), TOGETHER)
        bests = [_Best(floor[s : s + TOGETHER], k) for s in starts]
        q = None
        for batch in batches:
            for ids, x in unpacked(batch, d):
                q = q or [_turn(vectors[s : s + TOGETHER], axes, ends) for s in starts]
                c, ids = _turn(x, axes, ends), ids.to_numpy()
                longest = c.length.max()
                for s, some, best in zip(starts, q, bests):
                    active = np.flatnonzero(some.length * longest * (1 + SLACK) + 1e-6 >= best.floor)
                    if len(active):
                        i, j = _candidates(some[active], c, best.floor[active], ends)
                        i = active[i]
                        other = ids[j] != own[s + i]
                        i, j = i[other], j[other]
                        score = [_exact(some.x[i[a : a + PAIRS]], x[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)]
                        best.add(i, np.concatenate([np.zeros(0, np.int64), *score]), ids[j])
        for s, best in zip(starts, bests):
            columns = [pa.array(numbers[s + best.row]), pa.array(own[s + best.row]), pa.array(best.id), pa.array(best.score)]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "vec_id", "score"])

    return blocks.select("ids", "x").mapInArrow(run, "query long, query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _load(group: DataFrame, d: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, ids and vectors of a bounded group of queries."""
    parts = [p for batch in group.select("ids", "x").toArrow().to_batches() for p in unpacked(batch, d)]
    ids, vectors = np.concatenate([i.to_numpy() for i, _ in parts]), np.concatenate([x for _, x in parts])
    return before + np.arange(len(ids)), ids, vectors


def search(
    vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For every row that ``is_query`` holds for, the k other rows of highest inner product of floor(1024 * x).

    Ties go to the smaller id.  Vectors that are null or hold null, NaN or infinite components take no part, nor do
    rows without an id; ids are whole numbers.  Shorter vectors count as ending in zeros.  A row is known by its id:
    none of the rows with a query's id answers it.  Repeated rows count each time, so a repeated query is answered
    as often.  Scores beyond a long are given as its nearest end.  Queries pass in bounded groups, each against
    all vectors.
    """
    spark = vectors.sparkSession
    chosen = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False)))
    known = finite(chosen.filter(F.col(id_col).isNotNull()), id_col, vector_col).withColumn("id", F.col("id").cast("long"))
    asked = finite(chosen.filter(F.col(id_col).isNotNull() & F.col("_query")), id_col, vector_col)
    asked = asked.withColumn("id", F.col("id").cast("long"))
    d = known.agg(F.max(F.size("v"))).first()[0] or 0
    length = known.withColumn("length", squared_length("v"))
    # Equal lengths, as copies have, are dealt by id.
    falling = length.repartitionByRange(F.col("length").desc(), "id").sortWithinPartitions(F.col("length").desc(), "id")
    blocks = materialize(pack(falling, d), "by-length")
    questions = materialize(pack(asked, d), "queries")
    axes, ends = rotation(blocks, d) if d else (np.zeros((0, 0)), [])
    longest = blocks.orderBy("part", "seq").limit(SEEDS)
    path, before = f"{shared_dir(spark)}/top-{uuid.uuid4().hex}", 0
    for group in in_groups(questions, F.size("ids"), GROUP):
        numbers, own, x = _load(group, d, before)
        floor = np.full(len(own), -np.inf)
        seeds = _ranked(_search(longest, d, (numbers, own, x, floor), axes, ends, k), k)
        for query, score in seeds.filter(F.col("rank") == k).select("query", "score").collect():
            floor[query - before] = _floor(np.array(score, np.int64))
        found = _ranked(_search(blocks, d, (numbers, own, x, floor), axes, ends, k), k)
        found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        before += len(own)
    kind = T.StructType.fromDDL("query_id long, rank int, vec_id long, score long")
    return spark.read.schema(kind).parquet(path) if before else spark.createDataFrame([], kind)
