"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and words of a whole text, in numpy over Arrow batches.  The trees are
grown on binned statistics of a bounded sample of labelled rows, then flattened into arrays that a
batch of documents descends level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import raw, spans, tidy, word_numbers
from quillspark.operators.scale import materialize

SAMPLE_ROWS = 40_000  # about so many labelled rows, by a hash of their ids, are used for fitting
THRESHOLD = 0.7

_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "bang", "bar", "markup", "other", "high")
_CLASS = np.full(256, 9, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 10
_CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]] = 3, 4
for _chars, _n in ((b".,;:'\"-()", 5), (b"!?", 6), (b"|", 7), (b"#%&$*=<>{}[]\\^~_@/+", 8)):
    _CLASS[list(_chars)] = _n
FEATURES = (
    "log_bytes", "log_words", *[f"share_{c}" for c in _CLASSES], "word_length", "distinct_words",
    "top_word", "repeated_next", "words_per_line", "distinct_lines", "longest_run",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text, over all its bytes and words; zeros for an empty text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)), dtype=np.float64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    sizes = np.diff(offsets)
    numbers, first = word_numbers(data, offsets)
    words = np.diff(first)
    kinds = _CLASS[data[lo:hi]]
    for i in range(rows):
        if not sizes[i]:
            continue
        a, b = offsets[i] - lo, offsets[i + 1] - lo
        share = np.bincount(kinds[a:b], minlength=len(_CLASSES)) / sizes[i]
        out[i, 2 : 2 + len(_CLASSES)] = share
        n = int(words[i])
        lines = np.flatnonzero(kinds[a:b] == 4)
        if n:
            own = numbers[first[i] : first[i + 1]]
            _, counts = np.unique(own, return_counts=True)
            out[i, -6] = len(counts) / n
            out[i, -5] = counts.max() / n
            out[i, -4] = np.count_nonzero(own[1:] == own[:-1]) / n
            out[i, -3] = np.log1p(n / (len(lines) + 1))
            out[i, -7] = (1 - share[3] - share[4]) * sizes[i] / n
        bounds = np.concatenate([[0], lines + 1, [b - a]])
        texts = {data[lo + a + s : lo + a + e].tobytes().strip() for s, e in zip(bounds[:-1], bounds[1:])}
        out[i, -2] = len(texts) / (len(lines) + 1)
        gaps = np.flatnonzero((kinds[a:b] == 3) | (kinds[a:b] == 4))
        ends = np.concatenate([[-1], gaps, [b - a]])
        out[i, -1] = np.log1p(np.diff(ends).max() - 1)
    out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(words)
    return out


@dataclass(frozen=True)
class Forest:
    """All trees in one set of arrays; a leaf points to itself and a child is ``left`` or ``left + 1``."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row, all trees and rows of a block descending together."""
        out = np.empty(len(x))
        for at in range(0, len(x), 2048):
            block = x[at : at + 2048]
            rows = np.arange(len(block))[:, None]
            node = np.repeat(self.roots[None, :], len(block), axis=0)
            for _ in range(self.depth):
                leaf = self.left[node] < 0
                right = block[rows, self.feature[node]] > self.cut[node]
                node = np.where(leaf, node, self.left[node] + right)
            total = self.base + self.value[node].sum(axis=1) if len(self.roots) else np.full(len(block), self.base)
            out[at : at + 2048] = 1 / (1 + np.exp(-total))
        return out


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.2,
    ridge: float = 2.0,
    smallest: float = 2.0,
) -> Forest:
    """Second-order boosting of the log loss on per-feature histograms.

    Without rows the score is 0.5; with one label only it is the smoothed share of that label.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    feature, cut, left, value, roots = [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        grid = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(g, c, side="left") for g, c in zip(grid, x.T)])
        total = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = y - p, p * (1 - p)
            roots.append(len(feature))
            node = np.full(len(y), len(feature))
            feature.append(0), cut.append(0.0), left.append(-1), value.append(0.0)
            level = [len(feature) - 1]
            for step in range(depth + 1):
                start, width = level[0], len(level)
                local = node - start
                live = local >= 0
                gs = np.bincount(local[live], grad[live], width)
                hs = np.bincount(local[live], hess[live], width)
                for k, n in enumerate(level):
                    value[n] = rate * gs[k] / (hs[k] + ridge)
                if step == depth:
                    break
                best = [(1e-6, 0, 0)] * width
                for f, g in enumerate(grid):
                    if not len(g):
                        continue
                    key = local[live] * (len(g) + 1) + binned[f][live]
                    shape = (width, len(g) + 1)
                    gl = np.bincount(key, grad[live], width * (len(g) + 1)).reshape(shape).cumsum(1)[:, :-1]
                    hl = np.bincount(key, hess[live], width * (len(g) + 1)).reshape(shape).cumsum(1)[:, :-1]
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
                    gain[(hl < smallest) | (hr < smallest)] = -1
                    for k, j in enumerate(gain.argmax(1)):
                        if gain[k, j] > best[k][0]:
                            best[k] = (gain[k, j], f, int(j))
                following, moved = [], np.full(len(y), -1)
                for k, (gain, f, j) in enumerate(best):
                    if gain <= 1e-6:
                        continue
                    n, child = level[k], len(feature)
                    feature[n], cut[n], left[n] = f, float(grid[f][j]), child
                    for _side in range(2):
                        feature.append(0), cut.append(0.0), left.append(-1), value.append(0.0)
                        following.append(len(feature) - 1)
                    mine = node == n
                    moved[mine] = child + (binned[f][mine] > j)
                # Rows of finished leaves keep their leaf for the update, below the next level's start.
                node = np.where(moved >= 0, moved, node)
                if not following:
                    break
                level = following
            total += np.asarray(value)[node]
    return Forest(
        np.asarray(roots, dtype=np.int64), np.asarray(feature, dtype=np.int64), np.asarray(cut),
        np.asarray(left, dtype=np.int64), np.asarray(value), base, depth,
    )


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def _table(texts: DataFrame) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for a, b in spans(offsets):
                x = statistics(data, offsets[a : b + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(c) for c in x.T]],
                    names=["quality", *FEATURES],
                )

    schema = "quality int, " + ", ".join(f"{f} double" for f in FEATURES)
    return texts.select("quality", "text").mapInArrow(tidy(measure), schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> Forest:
    """Fit on the labelled documents of about ``sample_rows`` ids, those of the lowest hashes, or of all if they are fewer.

    An id labelled more than once takes the mean, ties giving 1; null ids and null labels are left out.
    """
    marked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    )
    marked = materialize(marked, "labelled")
    known = marked.count()
    if known > sample_rows:
        steps = 1 << 40
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < sample_rows * steps // known)
    rows = _table(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")).toArrow()
    y = rows.column(0).to_numpy().astype(np.float64)
    x = np.stack([rows.column(f).to_numpy() for f in FEATURES], axis=1)
    # Sums of floats depend on their order, rows arrive in any: sort them for equal reruns.
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order], **options)


def score(docs: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """Add the probability of good quality to every row; ids, sources and labels have no part in it.

    A null text counts as empty, and an empty one is scored by its (zero) statistics.  Nothing is shuffled.
    A column of ``docs`` with the name of the score is replaced.
    """
    kept = [c for c in docs.columns if c != name]
    names = [f"_{i}" for i in range(len(kept))]
    renamed = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(kept, names)])
    at = kept.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(at))
            for a, b in spans(offsets):
                values = forest.score(statistics(data, offsets[a : b + 1]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(values)], names=[*names, "_score"]
                )

    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in names)
    out = renamed.mapInArrow(tidy(apply), f"{schema}, _score double")
    return out.select(*[out[n].alias(c) for c, n in zip(kept, names)], out["_score"].alias(name))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Rows of ``docs`` with held_out and score, the held-out fold having no part in fitting."""
    known = labels.filter(fold(F.col("doc_id"), folds) != held)
    out = score(docs, train(docs, known))
    return out.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)))
