"""Benchmark decontamination by latent semantic retrieval.

Passages of documents and benchmark items are TF-IDF vectors over the benchmark's terms.  A randomised
SVD over all of them, its products summed in Spark, gives a latent space; every passage of every document whose weight
lies enough in these terms is compared there with the items by cosine.  Candidates are then
checked: the longest common subsequence with the item, and the item's rarest words, its answer, must be there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.brown_lm import Lookup
from quillspark.llm.words import raw, sequences, spans, tidy, word_numbers
from quillspark.operators.scale import materialize

BLOCK_ITEMS = 20_000  # benchmark items compared in one pass; more are taken in further passes
WIDTHS, STEP = (20, 44), 10  # words of a passage, and between starts of passages
LEAST_PASSAGES = 200  # documents' passages together weigh in the SVD as much as the items, or as so many
ENTRIES = 512  # entries of sparse rows multiplied at a time
RANK, OVER = 128, 16
SLOT_BITS = 16  # document frequencies are counted by hash
SLOTS = 1 << SLOT_BITS
ROWS = 32  # texts whose slots are marked at a time
WEIGHT = 0.3  # share of a passage's squared weight that must be benchmark terms
COSINE = 0.5
COMMON = 0.6  # share of an item's words in the longest common subsequence
ANSWER, ANSWERED = 10, 3  # rarest words of an item, and how many must be in the passage
TOGETHER = 512  # passages whose latent vectors are computed at a time
PRESENT = 20_000  # pairs of words compared directly
SHORT = 8  # items of fewer words are looked up as sequences

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of lower-cased words without ASCII punctuation, and the first word of each row."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    return word_numbers(_PLAIN[data[lo:hi]], offsets - lo)


def _slot(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _holders(slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per slot the number of rows that have it."""
    total = np.zeros(SLOTS, dtype=np.int64)
    for a in range(0, len(first) - 1, ROWS):
        own = first[a : a + ROWS + 1]
        seen = np.zeros((len(own) - 1, SLOTS), dtype=np.uint8)
        seen[np.repeat(np.arange(len(own) - 1), np.diff(own)), slots[own[0] : own[-1]]] = 1
        total += np.add.reduce(seen, axis=0, dtype=np.uint8)
    return total


def _count_and_cut(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """In one pass over all texts, (slot, n) sums of each task and (terms) of each passage that holds some of ``terms``.

    The two slots after the last one count the texts and all passages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(shared.value)
        total = np.zeros(SLOTS + 2, dtype=np.int64)
        names = ["slot", "n", "terms"]
        for batch in batches:
            data, offsets = raw(batch.column(0))
            for a, b in spans(offsets):
                numbers, first = _words(data, offsets[a : b + 1])
                total[:-2] += _holders(_slot(numbers), first)
                _, start, end = _windows(first, WIDTHS[-1], WIDTHS[-1])
                total[-2:] += b - a, len(start)
                place, sizes = find(numbers), end - start
                held = place[np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                before = np.concatenate([[0], np.cumsum(place >= 0)])
                counts = before[end] - before[start]
                ends = np.concatenate([[0], np.cumsum(counts[counts > 0])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(held[held >= 0], pa.int32()))
                none = pa.nulls(len(lists), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, lists], names=names)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used]), pa.nulls(len(used), kind)], names=names)

    return docs.select("text").mapInArrow(tidy(run), "slot long, n long, terms array<int>")


def inverse_frequencies(counted: DataFrame) -> tuple[np.ndarray, int]:
    """Per hash slot log((documents + 1) / (documents with it + 1)) over all documents, and the number of their passages."""
    rows = counted.filter("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS + 2)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return np.log((counts[-2] + 1) / (np.minimum(counts[:-2], counts[-2]) + 1)) + 1e-3, int(counts[-1])


@dataclass(frozen=True)
class Items:
    ids: np.ndarray
    words: list[np.ndarray]
    terms: np.ndarray  # sorted numbers of all their words
    rare: list[np.ndarray]


def _item_words(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of the words of each item, and the sorted numbers of all."""
    data, offsets = raw(rows.column("text").combine_chunks())
    numbers, first = _words(data, offsets)
    return [numbers[a:b] for a, b in zip(first[:-1], first[1:])], np.unique(numbers)


def _items(ids: np.ndarray, words: list[np.ndarray], terms: np.ndarray, idf: np.ndarray) -> Items:
    rare = []
    for own in words:
        once = np.unique(own)
        rare.append(once[np.lexsort((once, -idf[_slot(once)]))][:ANSWER])
    return Items(ids, words, terms, rare)


def _windows(first: np.ndarray, width: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of passages that cover every word of every row that has any."""
    sizes = np.diff(first)
    number = np.where(sizes > 0, np.maximum(0, -(-(sizes - width) // step)) + 1, 0)
    row = np.repeat(np.arange(len(sizes)), number)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    start = first[row] + np.minimum(nth * step, np.maximum(sizes[row] - width, 0))
    return row, start, np.minimum(start + width, first[row + 1])


def _dense(
    terms: np.ndarray, first: np.ndarray, entries: np.ndarray | None = None
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of sparse rows as (from, to, the terms that they hold, a matrix over these); an entry is 1 if not given."""
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)
    there = np.zeros(int(terms.max(initial=-1)) + 1, dtype=bool)
    place = np.zeros(len(there), dtype=np.int64)
    for a, b in spans(first, ENTRIES):
        own = slice(first[a], first[b])
        there[terms[own]] = True
        used = np.flatnonzero(there)
        if len(used):
            there[used], place[used] = False, np.arange(len(used))
            cell = (row[own] - a) * len(used) + place[terms[own]]
            sums = np.bincount(cell, None if entries is None else entries[own], minlength=(b - a) * len(used))
            yield a, b, used, sums.astype(np.float32).reshape(b - a, -1)


def _gram_times(rows: DataFrame, basis: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """A'A times a basis, for the sparse unit rows of A: partial sums by task, then by term in Spark."""
    shared = rows.sparkSession.sparkContext.broadcast((basis.astype(np.float32), weight))
    names = [f"v{j}" for j in range(basis.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, weight = shared.value
        total = np.zeros(right.shape)
        for batch in batches:
            lists = batch.column("terms")
            terms = lists.flatten().to_numpy()
            entries = batch.column("weights").flatten().to_numpy() if weight is None else weight[terms]
            times = batch.column("times").to_numpy() if "times" in batch.schema.names else np.ones(batch.num_rows)
            sizes = pc.list_value_length(lists).to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            for a, b, used, dense in _dense(terms, first, entries):
                squares = np.maximum(np.einsum("ij,ij->i", dense, dense), np.float32(1e-30))
                total[used] += dense.T @ (dense @ right[used] * (times[a:b] / squares).astype(np.float32)[:, None])
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(total[used, j].astype(np.float32)) for j in range(right.shape[1])]], names=["term", *names]
        )

    sums = rows.mapInArrow(tidy(run), "term long, " + ", ".join(f"{n} float" for n in names))
    got = sums.groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros_like(basis)
    out[got.column("term").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], axis=1)
    return out


def latent_space(
    rows: DataFrame, terms: int, rank: int = RANK, rounds: int = 2, weight: np.ndarray | None = None
) -> np.ndarray:
    """Right singular vectors (terms x rank) of the rows, by a randomised range finder with power rounds.

    ``rows`` has the ``terms`` of each row and their ``weights``, or ``weight`` holds one for each term.  A row with a number
    of ``times`` counts in A'A that often.
    """
    width = min(terms, rank + OVER)
    basis = np.random.default_rng(11).standard_normal((terms, width))
    for _ in range(rounds):
        basis, _ = np.linalg.qr(_gram_times(rows, basis, weight))
    inner = basis.T @ _gram_times(rows, basis, weight)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[: min(rank, width)]]


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def _present(words: np.ndarray, text: np.ndarray) -> int:
    """How many of the words are in the text."""
    if len(words) * len(text) > PRESENT:
        return int(np.isin(words, text).sum())
    return int((words[:, None] == text).any(axis=1).sum())


class Sequences:
    """Where the items of fewer than ``SHORT`` words stand in texts, by the numbers of their word sequences."""

    def __init__(self, words: list[np.ndarray]):
        self.of_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for length in range(1, SHORT):
            items = [i for i, own in enumerate(words) if len(own) == length]
            if items:
                numbers = np.concatenate([sequences(words[i], length) for i in items])
                known, back = np.unique(numbers, return_inverse=True)
                holders: list[list[int]] = [[] for _ in known]
                for i, k in zip(items, back):
                    holders[k].append(i)
                self.of_length[length] = known, holders

    def __call__(self, numbers: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, start) of the first place of each item in each row."""
        for length, (known, holders) in self.of_length.items():
            if len(numbers) < length:
                continue
            own = sequences(numbers, length)
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            start = np.flatnonzero(known[place] == own)
            row = np.searchsorted(first, start, side="right") - 1
            inside = start + length <= first[row + 1]  # a sequence ends in the text it began in
            start, row = start[inside], row[inside]
            _, once = np.unique(row * len(known) + place[start], return_index=True)
            for r, at in zip(row[once], start[once]):
                for item in holders[place[at]]:
                    yield int(r), item, int(at)


HIT = "item_id: bigint, word: bigint, cosine: double, common: double, answered: int"


def _search(docs: DataFrame, items: Items, space: np.ndarray, idf: np.ndarray, cosine: float) -> DataFrame:
    weight = idf[_slot(items.terms)]
    scaled = (space * weight[:, None]).astype(np.float32)  # what one word adds to a passage's latent vector
    latent = np.zeros((len(items.words), space.shape[1]), dtype=np.float32)
    for i, own in enumerate(items.words):
        latent[i] = scaled[np.searchsorted(items.terms, own)].sum(axis=0)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast((items, scaled, latent, idf))
    names = [f"_{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    at = docs.columns.index("text")
    hit = pa.struct([("item_id", pa.int64()), ("word", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answered", pa.int32())])

    def candidates(numbers: np.ndarray, first: np.ndarray, find: Lookup) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, start, end, item, cosine) of passages near an item."""
        own, scaled, latent, idf = shared.value
        place = find(numbers)
        squares = idf[_slot(numbers)] ** 2
        whole = np.concatenate([[0.0], np.cumsum(squares)])
        inside = np.concatenate([[0.0], np.cumsum(np.where(place >= 0, squares, 0.0))])
        before = np.concatenate([[0], np.cumsum(place >= 0)])
        for width in WIDTHS:
            row, start, end = _windows(first, width)
            share = (inside[end] - inside[start]) / np.maximum(whole[end] - whole[start], 1e-12)
            near_terms = np.flatnonzero(share >= WEIGHT)
            for at in range(0, len(near_terms), TOGETHER):
                group = near_terms[at : at + TOGETHER]
                sizes = end[group] - start[group]
                held = place[np.repeat(start[group] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                counts = before[end[group]] - before[start[group]]
                sums = np.zeros((len(group), scaled.shape[1]), dtype=np.float32)
                for a, b, used, dense in _dense(held[held >= 0], np.concatenate([[0], np.cumsum(counts)])):
                    sums[a:b] = dense @ scaled[used]
                sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
                near = sums @ latent.T
                for k, i in zip(*np.nonzero(near >= cosine)):
                    yield int(row[group[k]]), int(start[group[k]]), int(end[group[k]]), int(i), float(near[k, i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[0]
        find, short = Lookup(own.terms), Sequences(own.words)
        for batch in batches:
            data, offsets = raw(batch.column(at))
            for a, b in spans(offsets):
                numbers, first = _words(data, offsets[a : b + 1])
                # The passage that is the item itself has the item's latent vector.
                best: dict[tuple[int, int], tuple] = {
                    (row, i): (own.ids[i], start - first[row], 1.0, 1.0, len(own.rare[i])) for row, i, start in short(numbers, first)
                }
                if len(numbers):
                    for row, start, end, i, near in candidates(numbers, first, find):
                        item = own.words[i]
                        if len(item) < SHORT:  # looked up above
                            continue
                        lo, hi = max(first[row], start - len(item)), min(first[row + 1], end + len(item))
                        text = numbers[lo:hi]
                        old = best.get((row, i))
                        if old and old[2] >= near:
                            continue
                        answered = _present(own.rare[i], text)
                        if answered < min(ANSWERED, len(own.rare[i])) or _present(item, text) < COMMON * len(item):
                            continue
                        common = common_words(item, text) / len(item)
                        if common >= COMMON:
                            best[row, i] = (own.ids[i], start - first[row], near, common, answered)
                hits: list[list[tuple]] = [[] for _ in range(b - a)]
                for (row, _), values in sorted(best.items()):
                    hits[row].append(dict(zip(hit.names, values)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(hits, pa.list_(hit))], names=[*names, "_hits"]
                )

    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in names)
    out = renamed.mapInArrow(tidy(run), f"{schema}, _hits array<struct<{HIT}>>")
    return out.toDF(*docs.columns, "_found")


def find_items(docs: DataFrame, benchmark: DataFrame, name: str = "hits", cosine: float = COSINE) -> DataFrame:
    """Add to every row the benchmark items (item_id, text) its text holds, as an array of hits.

    Rows are searched in place and none is dropped.  Null and empty texts hold nothing; an item without words is held by
    nothing; items of one text are each reported.  Items of fewer than ``SHORT`` words are held where they stand word for
    word; their first place is reported.  Of an item's passages the one of the highest cosine is reported, of equal ones the
    first, 20-word passages before 44-word ones.  A column of ``docs`` named like the added one is replaced.
    """
    docs = docs.drop(name)
    items = materialize(benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text"), "items")
    blocks = -(-items.count() // BLOCK_ITEMS)
    out, found = docs, []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        words, terms = _item_words(rows)
        if not len(terms):
            continue
        counted = materialize(_count_and_cut(docs, terms), "passages")
        idf, passages = inverse_frequencies(counted)
        own = _items(rows.column("item_id").to_numpy(zero_copy_only=False), words, terms, idf)
        held = [np.searchsorted(terms, w).astype(np.int32) for w in words if len(w)]
        table = pa.table([pa.array(held, pa.list_(pa.int32())), pa.array(np.ones(len(held)))], names=["terms", "times"])
        # All passages count, together as much as the items.
        times = min(1.0, max(LEAST_PASSAGES, len(words)) / max(1, passages))
        cut = counted.filter("terms is not null").select("terms", F.lit(times).alias("times"))
        space = latent_space(cut.union(docs.sparkSession.createDataFrame(table, cut.schema)), len(terms), weight=idf[_slot(terms)])
        out = _search(out, own, space, idf, cosine)
        found.append(f"_found{block}")
        out = out.withColumnRenamed("_found", found[-1])
    hits = F.concat(*found) if found else F.array().cast(f"array<struct<{HIT}>>")
    return out.withColumn(name, hits).drop(*found)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item it holds."""
    hits = find_items(docs.select("doc_id", "text"), benchmark)
    return hits.select("doc_id", F.inline("hits"))
