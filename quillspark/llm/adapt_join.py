"""N-gram Jaccard join of all documents by adaptive multi-match prefixes.

A document is its set of distinct word shingles, in one order for all documents: shingles that are
common anywhere last, by a bounded count sketch.  Two sets of Jaccard similarity t share at least l of
the first n - ceil(t * n) + l shingles of each.  Every document picks its own l: a longer prefix
costs more index entries and leaves fewer candidates.  A pair is verified when its prefixes share the
smaller of the two l.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.components import components
from quillspark.llm.words import mix, raw, shingle_sets, spans, tidy, word_numbers
from quillspark.operators.scale import materialize, sized_join

WORDS = 5
PERCENT = 80
SKETCH_BITS = 18  # two rows of counters, whatever the size of the input
LONGEST = 8  # the largest number of shared prefix shingles asked for
PLAIN_READ = 0.05  # entries of other documents expected for a shingle that isn't known to be common
CHECK_COST = 1 / 16  # verifying a candidate of n shingles, in index entries read for each of them


def _sets(batch: pa.RecordBatch, at: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = raw(batch.column(at))
    for a, b in spans(offsets):
        numbers, first = word_numbers(data, offsets[a : b + 1])
        yield from enumerate(shingle_sets(numbers, first, k), a)


def set_key(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingles."""
    total = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _slots(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return (shingles & mask).astype(np.int64), ((shingles >> np.uint64(64 - SKETCH_BITS)) + mask + np.uint64(1)).astype(np.int64)


def scan(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """One pass over the texts: (doc_id, n, key) per row, and rows (slot, n) of the count sketch.

    ``key`` is null without words; ``slot`` is null in the rows of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            sizes, keys = [], []
            for _, shingles in _sets(batch, 1, k):
                sizes.append(len(shingles))
                keys.append(set_key(shingles) if len(shingles) else None)
                for slots in _slots(shingles):
                    np.add.at(counts, slots, 1)
            empty = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), empty],
                names=["doc_id", "n", "key", "slot"],
            )
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 1 << 16):
            slots = used[at : at + (1 << 16)]
            empty = pa.nulls(len(slots), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [empty, pa.array(counts[slots]), empty, pa.array(slots)], names=["doc_id", "n", "key", "slot"]
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, key long, slot long")


def levels(sketch: DataFrame) -> np.ndarray:
    """Per counter the rounded log2 of how far it is above the noise of its row; 0 within the noise."""
    rows = sketch.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 << SKETCH_BITS, dtype=np.float64)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    out = np.zeros(len(counts), dtype=np.int8)
    for row in np.split(np.arange(len(counts)), 2):
        noise = np.median(counts[row])
        excess = counts[row] - noise
        out[row] = np.where(excess > 8 * np.sqrt(noise) + 4, np.round(np.log2(np.maximum(excess, 1))), 0)
    return out


def prefix(shingles: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The shingles a document is indexed by, and how many of them a partner must share.

    Reading the entries of the first p shingles yields at most read / l candidates that appear l
    times; the l with the least reading and verifying is taken.
    """
    n = len(shingles)
    need = (percent * n + 99) // 100
    first, second = _slots(shingles)
    own = np.minimum(level[first], level[second])
    order = np.argsort(own, kind="stable")  # the shingles come in the order of their numbers
    most = min(LONGEST, need)
    read = np.cumsum(np.where(own[order] > 0, np.exp2(own[order]), PLAIN_READ))[n - need : n - need + most]
    asked = np.arange(1, most + 1)
    best = int(np.argmin(read + read / asked * n * CHECK_COST)) + 1
    return shingles[order[: n - need + best]], best


def entries(docs: DataFrame, level: np.ndarray, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Index entries (token, key, n, asked, place, width) of all documents' prefixes.

    ``place`` is a shingle's position in the document's order, ``width`` the length of the prefix.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, keys, sizes, asked, places, widths, held = [], [], [], [], [], [], 0
            for row, shingles in _sets(batch, 0, k):
                if len(shingles):
                    own, least = prefix(shingles, shared.value, percent)
                    tokens.append(own)
                    keys.append(np.full(len(own), set_key(shingles), dtype=np.int64))
                    sizes.append(np.full(len(own), len(shingles), dtype=np.int64))
                    asked.append(np.full(len(own), least, dtype=np.int32))
                    places.append(np.arange(len(own), dtype=np.int32))
                    widths.append(np.full(len(own), len(own), dtype=np.int32))
                    held += len(own)
                if held > 200_000 or (held and row + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(tokens).view(np.int64)),
                            *[pa.array(np.concatenate(c)) for c in (keys, sizes, asked, places, widths)],
                        ],
                        names=["token", "key", "n", "asked", "place", "width"],
                    )
                    tokens, keys, sizes, asked, places, widths, held = [], [], [], [], [], [], 0

    return docs.select("text").mapInArrow(tidy(run), "token long, key long, n long, asked int, place int, width int")


def _can_meet(n: str, place: str, m: str, other: str, percent: int, before: Column | int = 0) -> Column:
    """Whether sets of n and m shingles that share those at two places of their order can be alike.

    ``before`` is how many they may share before these; none if they are the first they share.
    """
    both = F.least(F.col(n) - F.col(place), F.col(m) - F.col(other)) + before
    return both * (100 + percent) >= (F.col(n) + F.col(m)) * percent


def _shingles(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(0))
            for a, b in spans(offsets):
                numbers, first = word_numbers(data, offsets[a : b + 1])
                sets = [s for s in shingle_sets(numbers, first, k) if len(s)]
                bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_key(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)),
                    ],
                    names=["key", "shingles"],
                )

    return docs.select("text").mapInArrow(tidy(run), "key long, shingles array<long>")


def _some_id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id")


def _verified(docs: DataFrame, first: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that are alike, by the whole sets of one document (key, doc_id) of each key in them."""
    pairs = materialize(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    ids = materialize(first.join(wanted, "key").select("doc_id").distinct(), "candidate-ids")
    texts = sized_join(docs.select(_some_id(), "text"), ids, ["doc_id"], "left_semi")
    sets = materialize(_shingles(texts, k), "candidate-sets")
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    union = F.size("_x") + F.size("_y") - both
    alike = pairs.join(left, "a").join(right, "b").filter(both * 100 >= union * percent)
    return materialize(alike.select("a", "b").distinct(), "alike")


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` (doc_id, n, key) and per key its component (key, root).

    Equal sets have one key and are compared once.  A shingle of a prefix that no other prefix holds makes no
    candidate, but it may still be in another set.  Pairs are ruled out only by their sizes and the places of
    a shingle they share.  Candidates are first checked against one leader for each token and size, the set with the
    fewest shingles alone in prefixes, which settles large groups of near copies; then every candidate
    pair across two components, so no link that would join components is lost.
    """
    # A null id takes part like any other; only the table of candidates' ids needs one.
    scanned = materialize(scan(docs, k), "shingle-scan")
    known = scanned.filter("slot is null").select("doc_id", "n", "key")
    level = levels(scanned.filter("slot is not null"))

    token = W.partitionBy("token")
    index = (
        entries(docs, level, k, percent)
        .withColumn("_low", F.min("key").over(token))
        .withColumn("_high", F.max("key").over(token))
        .filter("_low <> _high")
        .select("token", "key", "n", "asked", "place", "width")
        .distinct()
        .withColumn("alone", F.col("width") - F.count(F.lit(1)).over(W.partitionBy("key")))
        .drop("width")
    )
    index = materialize(index, "shared-prefixes")

    first = known.filter("key is not null").groupBy("key").agg(F.min(_some_id()).alias("doc_id"))

    # First against a leader for each token and size class.
    grade = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    group = W.partitionBy("token", "_grade")
    led = index.withColumn("_grade", grade).withColumn(
        "_leader", F.min(F.struct("alone", "key", "n", "asked", "place")).over(group)
    )
    stars = (
        led.filter("key <> _leader.key")
        .select(
            "key", "n", "asked", "place", F.col("_leader.key").alias("b"), F.col("_leader.n").alias("m"),
            F.col("_leader.asked").alias("l"), F.col("_leader.place").alias("other"),
        )
        .filter(_can_meet("n", "place", "m", "other", percent, F.least("place", "other")))
        .groupBy(F.col("key").alias("a"), "b")
        .agg(F.count(F.lit(1)).alias("c"), F.min(F.least("asked", "l")).alias("l"))
        .filter("c >= l")
        .select("a", "b")
    )
    links = _verified(docs, first, stars, k, percent)
    found = materialize(components(links), "star-components")

    # Then all candidates whose components still differ.  The first shingle that alike sets share has as many after it
    # as the smallest alike set would need.
    firsts = index.filter((F.col("n") - F.col("place")) * 100 >= F.col("n") * percent).drop("asked", "alone")
    rooted = firsts.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key")
    )
    apart = (
        rooted.withColumn("_low", F.min("root").over(token))
        .withColumn("_high", F.max("root").over(token))
        .filter("_low <> _high")
        .drop("_low", "_high")
    )
    apart = materialize(apart, "apart")
    other = apart.toDF(*[c if c == "token" else f"{c}_b" for c in apart.columns])
    # One row of a pair is that of the first shingle the sets share.
    near = (
        apart.join(other, "token")
        .filter((F.col("key") < F.col("key_b")) & (F.col("root") != F.col("root_b")))
        .filter(_can_meet("n", "place", "n_b", "place_b", percent))
        .select(F.col("key").alias("a"), F.col("key_b").alias("b"))
        .distinct()
    )
    prefixes = index.groupBy("key").agg(F.collect_list("token").alias("_tokens"), F.min("asked").alias("_asked"))
    pairs = (
        near.join(prefixes.select(F.col("key").alias("a"), F.col("_tokens").alias("_s"), F.col("_asked").alias("_l")), "a")
        .join(prefixes.select(F.col("key").alias("b"), F.col("_tokens").alias("_t"), F.col("_asked").alias("_m")), "b")
        .filter(F.size(F.array_intersect("_s", "_t")) >= F.least("_l", "_m"))
        .select("a", "b")
    )
    both = links.union(_verified(docs, first, pairs, k, percent))
    return known, materialize(components(both), "set-components").withColumnRenamed("node", "key")


def with_key(docs: DataFrame, name: str, k: int = WORDS) -> DataFrame:
    """Add the key of each text's set of shingles; null for a text without words."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(s) if len(s) else None for _, s in _sets(batch, at, k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*names, "_key"])

    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in names)
    return renamed.mapInArrow(tidy(run), f"{schema}, _key long").toDF(*docs.columns, name)


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, itself included.  Texts without
    words (null, empty, white space) are linked with nothing.  Rows with equal texts are linked, also when they
    share an id; a null id never becomes a component_id but where all ids of a component are null.
    """
    known, rooted = join(docs, k, percent)
    keys = known.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    placed = materialize(
        keys.join(rooted, "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root")), "placed"
    )
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "root").select("key", "component_id")
    return known.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
