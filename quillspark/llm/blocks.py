"""Rows packed into blocks for numpy, and bounded groups of blocks that pass through the driver one at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1024.0  # components become integers by floor(1024 * c)
ROWS = 2048  # vectors of a block
LONG = 2**63


def finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` of the rows whose vector is there and holds finite numbers only; an empty vector is kept."""
    v = F.col(vector_col).cast("array<double>")
    known = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    return known.filter(F.col("v").isNotNull() & F.forall("v", _is_finite))


def _is_finite(c: Column) -> Column:
    return c.isNotNull() & (F.abs(c) < F.lit(float("inf")))  # NaN is above infinity


def squared_length(v: str) -> Column:
    """Of the integer vector, in doubles."""
    return F.aggregate(v, F.lit(0.0), lambda s, c: s + F.floor(c * SCALE).cast("double") * F.floor(c * SCALE).cast("double"))


def integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(1024 * c), held to the range of a long, one row a vector; shorter vectors end in zeros."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    fits = np.abs(scaled) < 2.0**63
    x = np.where(fits, scaled, 0).astype(np.int64)
    x[~fits] = np.where(scaled[~fits] > 0, LONG - 1, -LONG)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == d).all():
        return x[ends[0] : ends[-1]].reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = x[ends[0] : ends[-1]]
    return out


def to_bytes(x: np.ndarray) -> bytes:
    """Integers in as few bytes each as they need."""
    most = max(int(x.max(initial=0)), -1 - int(x.min(initial=0)))
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64).tobytes()


def from_bytes(data: bytes, n: int) -> np.ndarray:
    """``n`` integers written by ``to_bytes``."""
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // n] if n else np.int16)


def block_type(id_type: T.DataType) -> T.StructType:
    return T.StructType().add("part", "long").add("seq", "long").add("ids", T.ArrayType(id_type)).add("x", "binary")


def pack(rows: DataFrame, d: int) -> DataFrame:
    """Blocks of up to ``ROWS`` integer vectors from ``id`` and ``v``, in the order of the rows; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0))
                x = pa.array([to_bytes(integers(piece.column(1), d))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), ids, x], names=["part", "seq", "ids", "x"])
                seq += 1

    return rows.select("id", "v").mapInArrow(run, block_type(rows.schema["id"].dataType))


def unpacked(batch: pa.RecordBatch, d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of each block of a batch."""
    ids, data = batch.column(batch.schema.get_field_index("ids")), batch.column(batch.schema.get_field_index("x"))
    for i in range(batch.num_rows):
        own = ids[i].values
        yield own, from_bytes(data[i].as_py(), len(own) * d).reshape(len(own), d)


def in_groups(blocks: DataFrame, size: Column, limit: int) -> Iterator[DataFrame]:
    """A stored table of blocks, keyed by ``part`` and ``seq``, as groups of at most ``limit`` or of one block each."""
    sizes = blocks.select("part", "seq", size.cast("long").alias("size")).orderBy("part", "seq")
    group, total = [], 0
    for part, seq, n in sizes.toLocalIterator():
        if group and total + n > limit:
            yield _of(blocks, group)
            group, total = [], 0
        group.append((part, seq))
        total += n
    if group:
        yield _of(blocks, group)


def _of(blocks: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """Consecutive blocks, by the first and the last key."""
    at, first, last = F.struct("part", "seq"), F.struct(*map(F.lit, keys[0])), F.struct(*map(F.lit, keys[-1]))
    key = T.StructType().add("part", "long").add("seq", "long")
    return blocks.filter(at.cast(key).between(first.cast(key), last.cast(key)))


def summed(cells: DataFrame, n: int) -> np.ndarray:
    """Sums of ``value`` by ``cell`` as a dense array."""
    out = np.zeros(n)
    for cell, value in cells.groupBy("cell").agg(F.sum("value")).collect():
        out[cell] = value
    return out


def cells(values: np.ndarray) -> pa.RecordBatch:
    at = np.arange(len(values), dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(values, pa.float64())], names=["cell", "value"])
