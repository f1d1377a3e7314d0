"""Building blocks that keep plans balanced when one key holds much of the data."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillspark.functions.columns import as_col

# A broadcast side must be measured to be no larger than this.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = (16, 256)  # fewest and most tasks a hot key is dealt over
BUCKET_WIDTH = 100_000
# What ``materialize`` has written within the innermost ``scratch``.
_written: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, as in tests, gets a private folder when none is named;
    on a cluster the executors could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if getattr(context, "_quillspark_dir", None) is None:
        context._quillspark_dir = tempfile.mkdtemp(prefix="quillspark-")
    return context._quillspark_dir


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Used where a costly input feeds two branches, so that it is computed once
    and a lost executor restarts from files instead of the whole lineage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    if (written := _written.get()) is not None:
        written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Remove what ``materialize`` writes inside when the block, or a function decorated with this, ends or fails.

    For steps that write their results themselves: no DataFrame that reads an intermediate result of the block may
    leave it.  Blocks nest, and each removes its own.
    """
    written: list[tuple[SparkSession, str]] = []
    token = _written.set(written)
    try:
        yield
    finally:
        _written.reset(token)
        for spark, path in written:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a small input arrives in fewer splits than there are cores.

    On a large input the scan already has more splits than cores and nothing
    moves.  For use right after a read: asking a plan with shuffles for its
    partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _width(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + F.lit(16)
    return F.lit(16)


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a candidate broadcast side; only one row reaches the driver."""
    if max_rows <= 0:
        return False
    size = sum((_width(f) for f in df.schema.fields), F.lit(0))
    rows, octets = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows <= max_rows and (octets or 0) <= max_bytes


def sized_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_by: list[str] | None = None,
    salts: int | None = None,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Equi-join with a right side that is usually small and never assumed to be.

    A right side measured within the bound is broadcast.  Beyond it the join is
    shuffled and salted: left rows of one key are dealt over ``salts`` tasks by
    a hash of ``salt_by`` (default: the whole row) and each right row is sent to all of them, so a hot
    key is split; the number follows the cluster and adaptive execution splits
    further what is still too large.  Works for the joins that keep left rows: inner, left,
    left_semi, left_anti.  Measuring is one pass over the right side, so a costly
    one should be materialized first.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    if fits_broadcast(right, max_rows, max_bytes):
        return left.join(F.broadcast(right), on, how)
    if salts is None:
        fewest, most = SALTS
        cores = left.sparkSession.sparkContext.defaultParallelism
        salts = min(most, max(fewest, cores // 8))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by or left.columns]), F.lit(salts)).cast("int")
    dealt = left.withColumn("_salt", salt)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def running_total(
    df: DataFrame,
    group: list[str],
    pos: str,
    value: Column | str,
    name: str,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Sum of ``value`` over the rows before this one in its group, by integer ``pos``.

    A plain window would pull a whole group into one task.  Positions are cut
    into buckets of ``width`` instead: totals inside a bucket by a window over
    (group, bucket), and bucket offsets by a window over one row per bucket.
    ``pos`` must be unique within the group and group columns must not be null.
    """
    valued = df.withColumn("_value", as_col(value)).withColumn(
        "_bucket", F.expr(f"`{pos}` div {int(width)}")
    )
    inside = W.partitionBy(*group, "_bucket").orderBy(pos)
    local = valued.withColumn(
        "_local",
        F.coalesce(F.sum("_value").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    )
    per_bucket = valued.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_total"))
    earlier = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *group, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    joined = local.join(offsets, [*group, "_bucket"], "left")
    return joined.withColumn(name, F.col("_local") + F.col("_offset")).drop(
        "_value", "_bucket", "_local", "_offset"
    )


def ordinal(df: DataFrame, index: str, pos: str, pos_bits: int = 31) -> Column:
    """(index, pos) as one number that sorts the same way.

    A number can be minimised by a hash aggregate, a struct needs a sort-based
    one.  Two 31-bit integers fit a bigint; a wider index falls back to decimal.
    """
    if isinstance(df.schema[index].dataType, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.shiftleft(F.col(index).cast("bigint"), pos_bits) + F.col(pos)
    return (
        F.col(index).cast("decimal(20,0)") * F.lit(2**pos_bits).cast("decimal(10,0)")
        + F.col(pos).cast("decimal(10,0)")
    )


def narrow_index(df: DataFrame, index: str) -> DataFrame:
    """Cast an index to int after checking, on that column alone, that all values fit."""
    low, high = df.agg(F.min(index), F.max(index)).first()
    fits = low is None or (low >= 0 and high < 2**31)
    return df.withColumn(index, F.col(index).cast("int")) if fits else df
