"""Token ids as Parquet list columns: encoded, written in id order, read back selectively.

The files are ordinary Parquet with dictionary or delta encoded ids, row groups and pages of a chosen
size, and column and page indexes, so a reader that wants a few documents or only the lengths touches
little of them.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.words import raw, spans, tidy, word_places
from quillspark.operators.scale import materialize, shared_dir

CACHE_BITS = 20  # a worker keeps the ids of up to 2**20 words, one for each slot
CACHE_IDS = 4_000_000  # and starts anew beyond this many ids
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1_000

_SIGNED = re.compile(r"[^\W\d_]+[.,!?;:#%&$*|)-]+")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """The tokenizers library behind a cache of words, known by their 64-bit numbers.

    Its pre-tokenizer never lets a piece cross ASCII white space, so a text's ids are those of its
    words in turn.  ``split=False`` encodes whole texts, for tokenizers of which that isn't known.
    """

    def __init__(self, path: str, split: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.split = split
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)  # ids that end a piece
        self.ends[[i for t, i in self.library.get_vocab(False).items() if suffix and t.endswith(suffix)]] = True
        self.numbers = np.zeros(1 << CACHE_BITS, np.uint64)
        self.starts = np.zeros(1 << CACHE_BITS, np.int32)
        self.sizes = np.zeros(1 << CACHE_BITS, np.int32)
        self.flat = np.zeros(CACHE_IDS // 8, np.int32)
        self.used = 0

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in one array, and how many each has."""
        lists = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, with words of letters, or letters and signs after them, encoded many at a time.

        The letters are a piece and the signs are one, and every piece ends with an id that says so.
        """
        pieces = [0] * len(words)
        if self.ends.any():
            pieces = [1 if w.isalpha() else 2 if _SIGNED.fullmatch(w) else 0 for w in words]
        sizes = np.zeros(len(words), np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int32)]
        order: list[np.ndarray] = []
        plain = [i for i, n in enumerate(pieces) if n]
        odd = [i for i, n in enumerate(pieces) if not n]
        for at in range(0, len(plain), 500):
            group = plain[at : at + 500]
            joined = " ".join([words[i] for i in group])
            (encoded,) = self.library.encode_batch_fast([joined], add_special_tokens=False)
            ids, wanted = np.array(encoded.ids, dtype=np.int32), np.array([pieces[i] for i in group])
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == wanted.sum() and ends[-1] == len(ids) - 1:
                sizes[group] = np.diff(ends[np.cumsum(wanted) - 1], prepend=-1)
                out.append(ids)
                order.append(np.array(group))
            else:  # some word has more pieces than its letters tell
                odd += group
        if odd:
            ids, n = self._each([words[i] for i in odd])
            sizes[odd] = n
            out.append(ids)
            order.append(np.array(odd))
        ids, order = np.concatenate(out), np.concatenate(order or [np.zeros(0, np.int64)])
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return _gather(ids, starts, sizes), sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a text column in one array, and how many each row has."""
        if not self.split:
            return self._each(
                [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
            )
        numbers, first, begin, end = word_places(data, offsets, lower=False)
        slot = (numbers & np.uint64((1 << CACHE_BITS) - 1)).astype(np.int32)
        starts, sizes = self.starts[slot], self.sizes[slot]
        missed = np.flatnonzero((self.numbers[slot] != numbers) | (sizes == 0))
        new, at, back = np.unique(numbers[missed], return_index=True, return_inverse=True)
        words = [data[begin[i] : end[i]].tobytes().decode() for i in missed[at].tolist()]
        ids, n = self._words(words)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(n) - n
        starts[missed], sizes[missed] = places[back], n[back]
        out = _gather(self.flat, starts.astype(np.int64), sizes.astype(np.int64))
        if self.used + len(ids) <= CACHE_IDS:
            self.used += len(ids)
            into = slot[missed[at]]
            self.numbers[into], self.starts[into], self.sizes[into] = new, places, n
        else:
            self.numbers[:], self.sizes[:], self.used = 0, 0, 0
            self.flat = self.flat[: CACHE_IDS // 8].copy()
        sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return out, np.diff(sums[first])


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def encoder(path: str, split: bool = True) -> Encoder:
    """One encoder for each file and worker process."""
    key = f"{path}:{split}"
    if key not in _encoders:
        _encoders[key] = Encoder(path, split)
    return _encoders[key]


def encode(docs: DataFrame, tokenizer: str, end_id: int | None, split: bool = True) -> DataFrame:
    """Replace ``text`` by ``n_tokens`` and ``ids``; a null text counts as empty, every text ends with ``end_id``."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    kept = [i for i in range(len(names)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, split)
        for batch in batches:
            data, offsets = raw(batch.column(at))
            for a, b in spans(offsets):
                part = batch.slice(a, b - a)
                ids, sizes = own.encode(data, offsets[a : b + 1])
                ends = np.cumsum(sizes)
                if end_id is not None:
                    ids, sizes = np.insert(ids, ends, end_id), sizes + 1
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in kept], pa.array(sizes, pa.int64()), lists],
                    names=[*[names[i] for i in kept], "_n", "_ids"],
                )

    renamed = docs.toDF(*names)
    schema = ", ".join(f"{names[i]} {renamed.schema[names[i]].dataType.simpleString()}" for i in kept)
    out = renamed.mapInArrow(tidy(run), ", ".join(filter(None, [schema, "_n long, _ids array<int>"])))
    return out.toDF(*[docs.columns[i] for i in kept], "n_tokens", "ids")


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = None,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
    split: bool = True,
    order: tuple[str, ...] = ("doc_id", "text"),
) -> None:
    """Write one row per document in ascending doc_id order (nulls first), files in that order too.

    Columns: doc_id, part (number of the file), seq (row in the file), n_tokens, ids.  Extra columns are
    left out.  Rows of one id stand in the order of their texts.  ``order`` names other columns to write by.
    ``encoding`` is "dictionary" or "delta".
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    dealt = order[:1] if order[0] == "doc_id" else order
    named = docs.select(*dict.fromkeys(["doc_id", "text", *order]))
    ordered = named.repartitionByRange(*dealt).sortWithinPartitions(*order)
    placed = ordered.select(
        "doc_id", "text", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"),
    )
    encoded = encode(placed, tokenizer, end_id, split)
    ids = "ids.list.element"
    (
        encoded.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")  # delta encoding where there is no dictionary
        .option("parquet.enable.dictionary", "false")
        .option(f"parquet.enable.dictionary#{ids}", "true" if encoding == "dictionary" else "false")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The stored rows; only the named columns are read, and filters on doc_id reach the indexes."""
    rows = spark.read.schema("doc_id long, part int, seq long, n_tokens long, ids array<int>").parquet(path)
    return rows.select(*columns) if columns else rows


def with_start(rows: DataFrame, counted: str = "n_tokens") -> DataFrame:
    """Add the number of ids in all rows before, in file order.

    Running sums inside a file, and one row per file for the sums of the files before.
    """
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    files = rows.groupBy("part").agg(F.sum(counted).alias("_n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = files.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.coalesce(F.sum(counted).over(inside), F.lit(0)))
    return local.join(before, "part").withColumn("start", F.col("_local") + F.col("_before")).drop("_local", "_before")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, part, seq, n_tokens and ids_crc32, both taken from the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"],
            )

    schema = "doc_id long, part int, seq long, n_tokens long, ids_crc32 long"
    return rows.select("doc_id", "part", "seq", "ids").mapInArrow(tidy(run), schema)


def token_files(
    spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, order: tuple[str, ...] = ("doc_id", "text")
) -> DataFrame:
    """Write ``docs`` by ``order`` to new files in the shared folder and describe every document as read from them."""
    path = os.path.join(shared_dir(spark), f"tokens-{uuid.uuid4().hex}")
    write_tokens(docs, path, tokenizer, end_id, order=order)
    described = with_start(materialize(checksums(read_tokens(spark, path)), "token-sums"))
    return described.select("doc_id", "start", "n_tokens", "ids_crc32")
