"""Ranked lexical search with a tree over items and a tree over documents.

Documents are vectors of term values, items vectors of term weights.  A node of either tree holds the largest value of
each coordinate among its members, so the product of two nodes bounds every score between them.  Documents are dealt
by their two strongest terms, which puts alike ones into one node.  A pair of nodes is left, with all
scores in it, when its bound is below the weakest kth score of the node's items; what is left at the leaves is scored in
integers.

Words are known by 64-bit numbers.  Only terms of the items are kept from the texts; counts of documents and of
terms cover everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillspark.llm.blocks import in_groups
from quillspark.llm.words import raw, spans, word_numbers
from quillspark.operators.scale import materialize, shared_dir

TOP = 50
ENTRIES = 1 << 21  # terms of items, repeats across items counted, that travel with the tasks at a time
ITEM_BLOCK = 1 << 16  # of these in one stored block; a longer item is a block of its own
FAN = 8  # members of a node of items
CHUNK, NODE, LEAF = 2048, 128, 16  # documents of the roots, the inner nodes and the leaves
SEED_SHARE = 16  # one of so many chunks is searched first, for kth scores to begin with
PENDING = 1 << 16  # scores kept before the best are chosen
LAST = np.iinfo(np.int64).max

_TERM = np.arange(256, dtype=np.uint8)
_TERM[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all terms of the rows, and per row the index of its first."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    return word_numbers(_TERM[data[lo:hi]], offsets - lo)


def _counted(keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of each row's entries, terms and counts, from row << 32 | term of every occurrence."""
    pairs, counts = np.unique(keys, return_counts=True)
    ends = np.searchsorted(pairs, np.arange(rows + 1) << 32)
    return ends, pairs & 0xFFFFFFFF, counts


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and distinct term numbers of items; narrow."""
    kind = T.StructType().add("part", "long").add("seq", "long").add("ids", T.ArrayType(items.schema[id_col].dataType))
    kind = kind.add("terms", T.ArrayType(T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for a, b in spans(offsets, 4 * ITEM_BLOCK):
                numbers, first = _terms(data, offsets[a : b + 1])
                rows = [np.unique(numbers[f:g]).view(np.int64) for f, g in zip(first[:-1], first[1:])]
                ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                terms = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))
                one = pa.array([0, b - a], pa.int32())
                columns = [
                    pa.array([part]), pa.array([seq]), pa.ListArray.from_arrays(one, batch.column(0).slice(a, b - a)),
                    pa.ListArray.from_arrays(one, terms),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)
                seq += 1

    return items.select(id_col, text_col).mapInArrow(run, kind)


def _postings(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per document its id, its number of terms, and of terms in the sorted vocabulary their places and counts; narrow."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for a, b in spans(offsets):
                numbers, first = _terms(data, offsets[a : b + 1])
                at = np.minimum(np.searchsorted(known, numbers), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[at] == numbers) if len(known) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(b - a), np.diff(first))[hit]
                ends, terms, counts = _counted(row << 32 | at[hit], b - a)
                ends = pa.array(ends, pa.int32())
                columns = [
                    batch.column(0).slice(a, b - a), pa.array(np.diff(first).astype(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array(terms.astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def _keyed(postings: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Documents with term values in place of counts, and their two strongest terms; those without terms are left out."""
    sent = postings.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sent.value
        for batch in batches:
            terms, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            longer = 50 + (50 * batch.column(1).to_numpy() * n_docs) // n_terms  # the length, 100 for a mean one
            value = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(longer, sizes))
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((terms, -(weight[terms] * value), row))
            first = np.cumsum(sizes) - sizes
            top = terms[order[first]]
            second = terms[order[first + (sizes > 1)]]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, sizes.sum()), pa.int32()), pa.array(value.astype(np.int32)))
            columns = [pa.array(top), pa.array(second), batch.column(0), batch.column(2), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["top", "second", "doc_id", "terms", "value"])

    kind = "top int, second int, doc_id long, terms array<int>, value array<int>"
    return postings.filter(F.size("terms") > 0).mapInArrow(run, kind)


def _chunks(keyed: DataFrame) -> DataFrame:
    """Roots of the trees of documents: up to ``CHUNK`` alike documents in a row, in order."""
    kind = "lot int, ids array<long>, ends binary, terms binary, values binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(a, CHUNK)
                ends = piece.column(3).offsets.to_numpy()
                terms, values = piece.column(3).flatten().to_numpy(), piece.column(4).flatten().to_numpy()
                lot = int(terms.sum(dtype=np.int64) + values.sum(dtype=np.int64)) % SEED_SHARE
                ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(2))
                stored = [pa.array([v.astype(np.int32).tobytes()], pa.binary()) for v in (ends - ends[0], terms, values)]
                yield pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), ids, *stored], names=["lot", "ids", "ends", "terms", "values"])

    order = ["top", "second", "doc_id"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, kind)


@dataclass(frozen=True)
class Level:
    """Nodes of one level of the tree of items: entries of each, and the items or nodes below it."""

    ends: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    below: np.ndarray  # first member of each node, one more at the end
    items: np.ndarray  # first item of each node, one more at the end


def _maxima(row: np.ndarray, terms: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, terms and largest values of each row."""
    key = row << 32 | terms
    order = np.lexsort((values, key))
    key, values = key[order], values[order]
    last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
    return np.searchsorted(key[last], np.arange(rows + 1) << 32), key[last] & 0xFFFFFFFF, values[last]


def item_tree(ends: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """Order of the items that have terms, and levels from the root to the items themselves."""
    used = np.flatnonzero(np.diff(ends))
    strongest = np.array([terms[a + np.argmax(weights[a:b])] for a, b in zip(ends[used], ends[used + 1])], np.int64)
    order = used[np.lexsort((used, strongest))]
    pick = _ragged(ends, order)
    sizes = np.diff(ends)[order]
    at, n = np.arange(len(order) + 1), len(order)
    levels = [Level(np.append(0, np.cumsum(sizes)), terms[pick], weights[pick], at, at)]
    while n > 1:
        n, lower = -(-n // FAN), levels[0]
        below = np.minimum(np.arange(n + 1) * FAN, len(lower.below) - 1)
        row = np.repeat(np.arange(len(lower.ends) - 1) // FAN, np.diff(lower.ends))
        levels.insert(0, Level(*_maxima(row, lower.terms, lower.weights, n), below, lower.items[below]))
    return order, levels


def _ragged(ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of all entries of the rows, in their order."""
    sizes = ends[rows + 1] - ends[rows]
    return np.repeat(ends[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Search:
    """The best documents of each item among those of one task."""

    def __init__(self, levels: list[Level], floor: np.ndarray, n_terms: int, k: int):
        self.levels, self.k, self.items = levels, k, levels[-1]
        self.floor = np.maximum(floor, 1)  # scores above 0 only
        self.buffer, self.place = np.zeros(n_terms, np.int64), np.full(n_terms, -1, np.int64)
        self.pending: list[tuple] = []
        self.size = 0
        self.best = tuple(np.zeros(0, np.int64) for _ in range(4))

    def chunk(self, ids: np.ndarray, none: np.ndarray, ends: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.none, self.ends, self.terms, self.values = ids, none, ends, terms, values
        self._visit(0, len(ids), CHUNK, 0, np.arange(len(self.levels[0].ends) - 1))

    def _alive(self, a: int, b: int, level: Level, nodes: np.ndarray) -> np.ndarray:
        """Nodes of items whose bound with documents a to b reaches the weakest kth score in them."""
        part = slice(self.ends[a], self.ends[b])
        np.maximum.at(self.buffer, self.terms[part], self.values[part])
        pick = _ragged(level.ends, nodes)
        sizes = level.ends[nodes + 1] - level.ends[nodes]
        bound = np.add.reduceat(level.weights[pick] * self.buffer[level.terms[pick]], np.cumsum(sizes) - sizes)
        self.buffer[self.terms[part]] = 0
        weakest = np.minimum.reduceat(self.floor, level.items[:-1])[nodes]
        return nodes[bound >= weakest]

    def _visit(self, a: int, b: int, width: int, depth: int, nodes: np.ndarray) -> None:
        level = self.levels[min(depth, len(self.levels) - 1)]
        nodes = self._alive(a, b, level, nodes)
        while width == LEAF and len(nodes) and depth < len(self.levels) - 1:
            nodes, depth = _ragged(level.below, nodes), depth + 1
            level = self.levels[depth]
            nodes = self._alive(a, b, level, nodes)
        if not len(nodes):
            return
        if width == LEAF:
            self._score(a, b, nodes)
            return
        if depth < len(self.levels) - 1:
            nodes, depth = _ragged(level.below, nodes), depth + 1
        width = NODE if width == CHUNK else LEAF
        for start in range(a, b, width):
            self._visit(start, min(start + width, b), width, depth, nodes)

    def _score(self, a: int, b: int, items: np.ndarray) -> None:
        part = slice(self.ends[a], self.ends[b])
        used = np.unique(self.terms[part])
        self.place[used] = np.arange(len(used))
        dense = np.zeros((b - a, len(used) + 1), np.int64)  # the last column is for terms of no document here
        dense[np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1])), self.place[self.terms[part]]] = self.values[part]
        for some in np.array_split(items, -(-len(items) // 256)):
            pick = _ragged(self.items.ends, some)
            sizes = self.items.ends[some + 1] - self.items.ends[some]
            products = dense[:, self.place[self.items.terms[pick]]] * self.items.weights[pick]
            scores = np.add.reduceat(products, np.cumsum(sizes) - sizes, axis=1)
            doc, item = np.nonzero(scores >= self.floor[some])
            self.pending.append((some[item], scores[doc, item], self.none[a + doc], self.ids[a + doc]))
            self.size += len(doc)
        self.place[used] = -1
        if self.size > PENDING:
            self.choose()

    def choose(self) -> None:
        """Keep the k best of each item, by falling score, then by id."""
        item, score, none, ids = (np.concatenate(p) for p in zip(self.best, *self.pending))
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, place = (x[place < self.k] for x in (order, item, place))
        self.best = item, score[order], none[order], ids[order]
        full = place == self.k - 1
        self.floor[item[full]] = np.maximum(self.floor[item[full]], self.best[1][full])
        self.pending, self.size = [], 0


def _search(chunks: DataFrame, tree: tuple, floor: np.ndarray, n_terms: int, k: int) -> DataFrame:
    """The best documents of each item in each task: the item's number, the id and the score."""
    order, levels = tree
    sent = chunks.sparkSession.sparkContext.broadcast((levels, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, floor = sent.value
        search = _Search(levels, floor, n_terms, k)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                none = np.asarray(ids.is_null()).astype(np.int64)
                stored = [np.frombuffer(batch.column(c)[i].as_py(), np.int32).astype(np.int64) for c in (1, 2, 3)]
                search.chunk(ids.fill_null(LAST).to_numpy(), none, *stored)
        search.choose()
        item, score, none, ids = search.best
        columns = [pa.array(order[item]), pa.array(ids, mask=none.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return chunks.select("ids", "ends", "terms", "values").mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _weights(postings: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term, number of documents with terms, and number of all their terms."""
    n_docs, n_terms = postings.filter(F.col("n") > 0).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(size)
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * df + 1))).astype(np.int64), n_docs, n_terms


def rank(
    docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """Per item its k documents of highest score above 0.

    A null text has no terms; such a document counts nowhere, such an item finds nothing.  Equal scores go to the
    smaller id, null ids last; every row is a document or an item of its own, also when ids or whole rows repeat.
    Items pass in bounded groups, each against all documents.
    """
    spark = docs.sparkSession
    blocks = materialize(_item_blocks(items, item_id, text), "items")
    entries = F.aggregate("terms", F.lit(0), lambda s, t: s + F.size(t)) + F.size("ids")
    kind = T.StructType().add("item_id", items.schema[item_id].dataType).add("rank", "integer").add("doc_id", "long").add("score", "long")
    path, some = f"{shared_dir(spark)}/ranked-{uuid.uuid4().hex}", False
    for group in in_groups(blocks, entries, ENTRIES):
        rows = group.select("ids", "terms").toArrow().combine_chunks()
        ids = pa.concat_arrays([c.flatten() for c in rows.column("ids").chunks])
        lists = pa.concat_arrays([c.flatten() for c in rows.column("terms").chunks])
        vocabulary, terms = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
        ends = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
        if not len(vocabulary):
            continue
        postings = materialize(_postings(docs, vocabulary, doc_id, text), "postings")
        weight, n_docs, n_terms = _weights(postings, len(vocabulary))
        if not n_docs:
            continue
        tree = item_tree(ends, terms, weight[terms])
        chunks = materialize(_chunks(_keyed(postings, weight, n_docs, n_terms)), "documents")
        floor = np.zeros(len(tree[0]), np.int64)
        first = _ranked(_search(chunks.filter("lot = 0"), tree, floor, len(vocabulary), k), k)
        place = dict(zip(tree[0].tolist(), range(len(tree[0]))))
        for item, score in first.filter(F.col("rank") == k).select("item", "score").collect():
            floor[place[item]] = score
        found = _ranked(_search(chunks, tree, floor, len(vocabulary), k), k)
        named = spark.createDataFrame(pa.table({"item": np.arange(len(ids)), "item_id": ids}))
        found.join(F.broadcast(named), "item").select(*kind.names).write.mode("append").parquet(path)
        some = True
    return spark.read.schema(kind).parquet(path) if some else spark.createDataFrame([], kind)
