"""Order MinHash fingerprints, in DataFrame functions only.

The elements of a text are its word k-mers, each with the number of its occurrence, so repeats differ.
Their hashes deal them over bins.  Each bin keeps its smallest elements, puts them back into text order and hashes
the tuple.  Two texts agree in a bin only if they share these elements in the same order, so the share of agreeing
bins falls with the edit distance, also where the sets of k-mers stay alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 3  # words of an element
PICKED = 2  # elements kept in a bin
BIN_BITS = 5
POSITION_BITS = 24  # elements beyond 2**24 of a text share the last position
KEPT = 512  # elements sorted at first; more only where some bin would be left short
RANK_BITS = 63 - BIN_BITS - POSITION_BITS
_SPACE = " \t\n\x0b\f\r"
_LAST = (1 << POSITION_BITS) - 1


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _bin(code: Column) -> Column:
    return F.shiftright(code, RANK_BITS + POSITION_BITS)


def _code(number: Column, occurrence: Column, position: Column) -> Column:
    """Bin, rank and position of an element in one number that sorts in this order."""
    mixed = F.shiftrightunsigned(F.xxhash64(number, occurrence), 64 - BIN_BITS - RANK_BITS)
    return F.shiftleft(mixed, POSITION_BITS).bitwiseOR(position)


def _indices(size: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(none)


def add_fingerprint(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Add the fingerprint of a text column: an array with one entry, bin and tuple hash, for each bin in use.

    Rows stay in place: every step works inside its row.  A null or blank text has no entries; a text of
    fewer than ``k`` words is a single element.
    """
    own = [c for c in df.columns if c != name]
    step = df.withColumn("_w", words(F.col(text)))
    last = F.when(F.size("_w") > 0, F.greatest(F.size("_w") - (k - 1), F.lit(1))).otherwise(F.lit(0))
    # Element numbers over their positions, sorted, so that equal elements stand together in text order.
    step = step.select(
        *own,
        F.sort_array(
            F.transform(
                _indices(last),
                lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(k)])
                .bitwiseAND(F.lit(-1 - _LAST))
                .bitwiseOR(F.least(i, F.lit(_LAST)).cast("long")),
            )
        ).alias("_a"),
    )
    number = lambda c: F.shiftright(c, POSITION_BITS)
    place = lambda c: c.bitwiseAND(F.lit(_LAST))
    step = step.select(
        *own, "_a",
        F.filter(
            _indices(F.size("_a")),
            lambda i: (i == 0) | (number(F.get(F.col("_a"), i)) != number(F.get(F.col("_a"), i - 1))),
        ).alias("_first"),
    )
    single = F.transform(F.col("_a"), lambda c: _code(number(c), F.lit(0), place(c)))
    repeated = F.flatten(
        F.transform(
            F.col("_first"),
            lambda start, r: F.transform(
                F.sequence(start, F.coalesce(F.get(F.col("_first"), r + 1), F.size("_a")) - 1),
                lambda i: _code(number(F.get(F.col("_a"), i)), i - start, place(F.get(F.col("_a"), i))),
            ),
        )
    )
    step = step.select(
        *own,
        F.when(F.size("_first") == F.size("_a"), single).otherwise(repeated).alias("_codes"),
    )
    # Only low ranks can be among a bin's smallest; sort those, and all of them where a bin is short.
    rank = lambda c: F.shiftright(c, POSITION_BITS).bitwiseAND(F.lit((1 << RANK_BITS) - 1))
    step = step.withColumn("_limit", (F.lit(float(1 << RANK_BITS)) * KEPT / F.greatest(F.size("_codes"), F.lit(KEPT))).cast("long"))
    step = step.withColumn("_low", F.sort_array(F.filter(F.col("_codes"), lambda c: rank(c) < F.col("_limit"))))
    smallest = lambda codes: F.filter(
        codes, lambda c, i: (i < PICKED) | (_bin(F.get(codes, i - PICKED)) != _bin(c))
    )
    step = step.withColumn("_picked", smallest(F.col("_low")))
    enough = (F.size("_picked") == PICKED << BIN_BITS) | (F.size("_codes") <= KEPT)
    step = step.withColumn(
        "_all", F.when(enough, F.array().cast("array<bigint>")).otherwise(F.sort_array("_codes"))
    ).withColumn("_enough", enough)
    step = step.withColumn("_picked", F.when(F.col("_enough"), F.col("_picked")).otherwise(smallest(F.col("_all"))))
    picked = F.col("_picked")
    heads = F.filter(
        _indices(F.size(picked)), lambda i: (i == 0) | (_bin(F.get(picked, i)) != _bin(F.get(picked, i - 1)))
    )
    step = step.select(*own, "_picked", heads.alias("_heads"))

    def entry(start: Column, r: Column) -> Column:
        after = F.coalesce(F.get(F.col("_heads"), r + 1), F.size("_picked"))
        mine = F.slice(F.col("_picked"), start + 1, after - start)
        inorder = F.sort_array(F.transform(mine, lambda c: F.struct(place(c).alias("p"), number(c).alias("n"))))
        tuple_hash = F.xxhash64(F.transform(inorder, lambda e: e["n"]))
        return F.concat(
            F.lpad(F.hex(_bin(F.get(F.col("_picked"), start))), 2, "0"),
            F.substring(F.lpad(F.hex(tuple_hash), 16, "0"), 1, 8),
        )

    return step.select(*own, F.transform(F.col("_heads"), entry).alias(name))


def likeness(a: str, b: str) -> Column:
    """Share of the bins in use that agree; 1 for two texts without words."""
    bins = lambda c: F.transform(F.col(c), lambda e: F.substring(e, 1, 2))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``value``, by a search in two steps; 0 for null."""
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not rows:
        return F.lit(0)
    coarse = F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), lambda b: b <= value))
    table = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows])
    fine = F.size(F.filter(F.coalesce(F.get(table, coarse - 1), F.array().cast("array<bigint>")), lambda b: b <= value))
    return F.when(value.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * width + fine)


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Add, as ``next_*``, columns of the next row by doc_id; the first row follows the last.

    Nulls come first, and rows of one id stand in the order of their text's hash.  Ids are cut into ranges of about
    equal numbers of rows; every range also gets a copy of the first row of the next one, so
    texts are shuffled once.
    """
    points = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx("doc_id", points, 10_000)).first()[0] if points else []
    bounds = sorted(set(found or []))
    placed = docs.withColumn("_th", F.xxhash64("text")).withColumn("_bucket", _bucket(F.col("doc_id"), bounds))
    firsts = placed.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_th")).alias("_f"))
    # One row for each range.
    ranges = W.orderBy("_bucket")
    whole = ranges.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = firsts.select(
        "_bucket", "_f.*",
        F.coalesce(F.lag("_bucket").over(ranges), F.max("_bucket").over(whole)).alias("_before"),
    ).select(F.struct("doc_id", "_th").alias("_first"), "_bucket", "_before")
    marked = placed.join(F.broadcast(firsts), "_bucket")
    is_first = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_th") == F.col("_first._th"))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_before").alias("b"), F.lit(True).alias("copy"))
    dealt = marked.withColumn("_to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))))
    order = W.partitionBy("_to.b").orderBy("_to.copy", "doc_id", "_th")
    led = dealt.select(
        *docs.columns, F.col("_to.copy").alias("_copy"), *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    )
    return led.filter(~F.col("_copy")).drop("_copy")


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are.

    The edited text has its last quarter replaced by the start of the next document.  A null text counts as empty;
    an empty one is not edited and is like any other text without words.  Extra columns are left out.
    """
    spark = docs.sparkSession
    parts = buckets or 8 * max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = with_next(add_fingerprint(plain, "text", "print"), ["text", "print"], parts)
    size = F.char_length("text")
    cut = F.floor(size / 4).cast("int")
    edited = printed.select(
        "doc_id", size.cast("long").alias("n_chars"), "print", "next_print",
        F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 4) as int))"),
                 F.left("next_text", cut)).alias("edited"),
    )
    both = add_fingerprint(edited, "edited", "edited_print")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.concat_ws("", "print").alias("fingerprint"), F.concat_ws("", "edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"),
    )
