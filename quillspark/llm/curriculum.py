"""Mix sources to target weights along a time-varying curriculum.

Every source offers one stream of words: its documents in a fixed pseudo-random order, over again for
a second epoch.  Its weight schedule, integrated, is its cumulative demand; inverting that demand
gives the training position at which each document of the stream starts.  Documents are then
range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.operators.scale import materialize

CYCLE = (3.0, 1.0, 2.0)  # weights of the sources in code-point order, repeating
SHARE = 1.5  # words of the mix per word of the input
EPOCHS = 2  # a source gives its words this many times at most
BUCKET_BITS = 12  # a source's order is cut into 2**12 ranges for its running sum
MAX_SOURCES = 100_000  # sources and their schedules are planned on the driver
PIECES = pa.list_(pa.struct([(name, pa.float64()) for name in "tqwg"]))
PLANNED = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("pieces", PIECES)])
# Weight over training time as (time, level) knots, by turns; the levels are scaled to the target.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    """Runs of characters outside 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[float], weights: Sequence[float], share: float, epochs: int) -> list[float]:
    """Split ``share`` of all words by weight; what exceeds a source's cap is dealt again by weight."""
    caps = [epochs * float(s) for s in sizes]
    out, left = [0.0] * len(caps), min(share * float(sum(sizes)), sum(caps))
    free = [i for i, c in enumerate(caps) if c > 0]
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total >= caps[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = caps[i]
        left -= sum(caps[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Pieces (start time, width, demand before, level, slope) of a schedule whose demand ends at 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if area <= 0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs levels of at least 0 and some above")
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 > t0 and w0 + w1 > 0:
            out.append((t0, before, w0 / area, (w1 - w0) / (t1 - t0) / area))
            before += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def plan(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    schedules: Mapping[str | None, Sequence[tuple[float, float]]] | None = None,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, content, size, source_size, target, taken, positions.

    ``positions`` holds the training position, 0 to 1, of each time the document is taken; the last
    document of a source may be taken in part.  Sources are known by ``source``, null being one of
    them, last.  A null or empty text has size 0 and is never taken.  Repeated rows count each on
    their own and equal rows are interchangeable; no order depends on how rows were dealt out.
    """
    sized = materialize(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.xxhash64("text", "source").alias("content"),
            F.xxhash64(F.lit(seed), "doc_id").alias("_h"),
        ),
        "mix-sizes",
    )
    spark = docs.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names = [r["source"] for r in totals]
    levels = [(weights or {}).get(s, CYCLE[i % len(CYCLE)]) for i, s in enumerate(names)]
    aims = targets([r["n"] for r in totals], levels, share, epochs)
    pieces = [segments((schedules or {}).get(s, SCHEDULES[i % len(SCHEDULES)])) for i, s in enumerate(names)]
    # As an Arrow table, which the JVM reads itself; rows from Python would start Python workers for nothing else.
    columns = [names, [r["n"] for r in totals], aims, [[dict(zip("tqwg", p)) for p in own] for own in pieces]]
    planned = spark.createDataFrame(
        pa.table([pa.array(c, kind) for c, kind in zip(columns, PLANNED.types)], schema=PLANNED)
    ).withColumn("_s", F.xxhash64(F.col("source").isNull(), "source"))
    keyed = sized.withColumn("_s", F.xxhash64(F.col("source").isNull(), "source")).withColumn(
        "_bucket", F.shiftrightunsigned("_h", 64 - BUCKET_BITS)
    )
    order = W.partitionBy("_s", "_bucket").orderBy("_h", "doc_id", "content")
    local = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = keyed.groupBy("_s", "_bucket").agg(F.sum("size").alias("_n"))
    earlier = W.partitionBy("_s").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_s", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    at = (
        keyed.withColumn("_local", local)
        .join(offsets, ["_s", "_bucket"])
        .join(F.broadcast(planned.drop("source")), "_s")  # one row for each source
        .withColumn("_u", F.col("_local") + F.col("_before"))
    )
    aim, starts = F.round("target").cast("long"), []
    for epoch in range(epochs):
        starts.append(F.col("_u") + F.lit(epoch) * F.col("source_size"))
    taken = sum(
        (F.greatest(F.lit(0), F.least(F.col("size"), aim - start)) for start in starts), F.lit(0)
    ).cast("long")
    met = [
        F.when((start < aim) & (F.col("size") > 0), _position(start / F.col("target"))) for start in starts
    ]
    return at.select(
        "doc_id", "content", "size", "source_size", "target", taken.alias("taken"),
        F.array_compact(F.array(*met)).alias("positions"),
    )


def _position(q: Column) -> Column:
    """Invert the demand: the time at which a share ``q`` of a source's words has been used."""
    piece = F.element_at(F.filter("pieces", lambda p: p["q"] <= q), -1)
    left, w, g = q - piece["q"], piece["w"], piece["g"]
    # w*t + g*t*t/2 = left, solved in the form that stays exact for g near 0
    root = F.sqrt(F.greatest(F.lit(0.0), w * w + F.lit(2.0) * g * left))
    bottom = w + root
    return F.least(F.lit(1.0), piece["t"] + F.when(bottom > 0, F.lit(2.0) * left / bottom).otherwise(0.0))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents taken, as often as taken, in training order, with the columns of ``docs``.

    Rows of one position stand in the order of their ids.  A document taken in part, the last one of a
    source, is given whole.
    """
    planned = (
        plan(docs, **options)
        .filter(F.size("positions") > 0)
        .groupBy(F.xxhash64("doc_id").alias("_k"))
        .agg(F.sort_array(F.collect_list(F.struct("content", "positions"))).alias("_all"))
    )
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(
        *[docs[f"`{c}`"].alias(n) for c, n in names.items()],
        F.xxhash64("doc_id").alias("_k"), F.xxhash64("text", "source").alias("_content"),
    )
    # Equal rows of one id take the entries of their content by turns.
    nth = F.row_number().over(W.partitionBy("_k").orderBy("_content"))
    same = W.partitionBy("_k", "_content")
    joined = keyed.join(planned, "_k").withColumn("_n", nth)
    joined = joined.withColumn("_n", F.col("_n") - F.min("_n").over(same) + 1)
    mine = F.filter("_all", lambda e: e["content"] == F.col("_content"))
    taken = joined.withColumn("_mine", F.get(mine, F.col("_n") - 1)).filter(F.col("_mine").isNotNull())
    copies = taken.withColumn("_position", F.explode("_mine.positions"))
    rows = copies.repartitionByRange("_position", names["doc_id"]).sortWithinPartitions(
        "_position", names["doc_id"]
    )
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


