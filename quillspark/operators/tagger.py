"""Tags and entity types of tokens by a structured averaged perceptron.

A sentence's labels are the path of highest score over features of its words and pairs of neighbouring labels (Viterbi).
The weights are fitted on a labelled token table by iterative parameter mixing: in each round every task goes once over its
share of the sentences, starting from the common weights, and Spark averages what the tasks changed.  Words are known by
hashed features, so the model has one size whatever the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.columns import explode_with_pos
from quillspark.functions.segment import sentence_lines
from quillspark.functions.chars import WORD
from quillspark.functions.words import RUN
from quillspark.operators.scale import materialize
from quillspark.operators.vocab import TokenProvider

SLOTS = 1 << 16  # hashed features
LABELS = 1000  # most labels: the weights have SLOTS x labels cells
PIECE = 512  # most tokens of a training sentence; a longer one is cut
TOGETHER = 256  # sentences decoded at a time
ROUNDS, SHARDS = 6, 8
_SPREAD = np.random.default_rng(5).integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1 << 16)
def _traits(word: str) -> tuple[int, int, int, int]:
    """Hashes of the lower-cased word, its ending, its beginning and its shape."""
    low = word.lower()
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else "-" for c in word]
    shape = "".join(c for c, before in zip(kinds, ["", *kinds]) if c != before)
    return tuple(zlib.crc32(f"{n}{x}".encode()) for n, x in enumerate((low, low[-3:], low[:2], shape)))  # type: ignore[return-value]


def features(words: list[str], slots: int) -> np.ndarray:
    """Per word its hashed features: its own traits, those of its neighbours, and whether it opens the sentence."""
    own = np.array([_traits(w) for w in words], dtype=np.uint64).reshape(len(words), 4)
    edge = np.zeros((1, 4), dtype=np.uint64)
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    opens = np.zeros(len(words), dtype=np.uint64)
    opens[:1] = 1
    columns = [*own.T, before[:, 0], before[:, 3], after[:, 0], after[:, 3], opens, own[:, 3] * np.uint64(3) + opens]
    mixed = [((c + np.uint64(k + 1)) * _SPREAD[k]) >> np.uint64(32) for k, c in enumerate(columns)]
    return (np.stack(mixed, axis=1) % np.uint64(slots)).astype(np.int64)


def best_paths(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The labels of highest score of each sentence; ``moves`` scores label pairs, its last row the first label.

    All sentences step forward together, the longest first; ties go to the lower label.
    """
    order = np.argsort([-len(s) for s in scores], kind="stable")
    sizes = np.array([len(scores[i]) for i in order])
    labels = moves.shape[1]
    longest = int(sizes[0]) if len(sizes) else 0
    live = [int((sizes > t).sum()) for t in range(longest)]
    back, ends = [], np.zeros((len(scores), labels))
    for t in range(longest):
        here = np.stack([scores[i][t] for i in order[: live[t]]])
        if t == 0:
            ends[: live[0]] = here + moves[-1]
            continue
        paths = ends[: live[t], :, None] + moves[:-1]
        back.append(paths.argmax(axis=1))
        ends[: live[t]] = paths.max(axis=1) + here
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(scores)
    for k, i in enumerate(order):
        path = np.zeros(sizes[k], dtype=np.int64)
        if len(path):
            path[-1] = ends[k].argmax()
            for t in range(len(path) - 2, -1, -1):
                path[t] = back[t][k, path[t + 1]]
        out[i] = path
    return out


@dataclass(frozen=True)
class Tagger:
    labels: list[tuple[str | None, str | None]]  # (tag, entity type)
    emit: np.ndarray  # slots x labels
    moves: np.ndarray  # (labels + 1) x labels

    def label(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """Positions in ``labels`` for the words of each sentence."""
        found: list[np.ndarray] = []
        for at in range(0, len(sentences), TOGETHER):
            group = sentences[at : at + TOGETHER]
            found += best_paths([self.emit[features(s, len(self.emit))].sum(axis=1) for s in group], self.moves)
        return found


def labelled_sentences(tokens: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Rows (words, tags, types) from tokens (sentence, pos, text, tag, ent_type); an empty type is none.

    Tokens without sentence or text are left out.  A sentence of more than ``PIECE`` tokens makes several rows.
    """
    token = F.struct("pos", "text", "tag", F.nullif("ent_type", F.lit("")).alias("ent_type"))
    known = tokens.filter(F.col(sentence).isNotNull() & F.col("text").isNotNull())
    pieces = known.groupBy(sentence, F.floor(F.col("pos") / PIECE).alias("_piece"))
    rows = pieces.agg(F.array_sort(F.collect_list(token)).alias("_t"))
    return rows.select(F.col("_t.text").alias("words"), F.col("_t.tag").alias("tags"), F.col("_t.ent_type").alias("types"))


def _share(sentences: DataFrame, tagger: Tagger) -> DataFrame:
    """(code, change, mean) of each task's pass: what it changed at the end, and on average; code -1 counts tasks."""
    shared = sentences.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        number = {label: k for k, label in enumerate(start.labels)}
        slots, width = start.emit.shape
        emit, moves = start.emit.copy(), start.moves.copy()
        late_emit, late_moves = np.zeros_like(emit), np.zeros_like(moves)  # changes times the steps before them
        steps = 0
        for batch in batches:
            for words, tags, types in zip(*(batch.column(i).to_pylist() for i in range(3))):
                right = np.array([number[pair] for pair in zip(tags, types)])
                seen = features(words, slots)
                guess = best_paths([emit[seen].sum(axis=1)], moves)[0]
                wrong = np.flatnonzero(guess != right)
                if len(wrong):
                    for path, sign in ((right, 1.0), (guess, -1.0)):
                        at = seen[wrong], path[wrong, None]
                        before = np.concatenate([[width], path[:-1]])
                        np.add.at(emit, at, sign)
                        np.add.at(late_emit, at, sign * steps)
                        np.add.at(moves, (before, path), sign)
                        np.add.at(late_moves, (before, path), sign * steps)
                steps += 1
        if not steps:
            return
        change = np.concatenate([(emit - start.emit).ravel(), (moves - start.moves).ravel()])
        mean = change - np.concatenate([late_emit.ravel(), late_moves.ravel()]) / steps
        used = np.flatnonzero((change != 0) | (mean != 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(change[used], 1.0)), pa.array(np.append(mean[used], 1.0))],
            names=["code", "change", "mean"],
        )

    rows = sentences.mapInArrow(run, "code long, change double, mean double")
    return rows.groupBy("code").agg(F.sum("change").alias("change"), F.sum("mean").alias("mean"))


def fit(sentences: DataFrame, rounds: int = ROUNDS, shards: int = SHARDS, slots: int = SLOTS) -> Tagger:
    """Weights from rows (words, tags, types) of one sentence each; without rows every token is unlabelled.

    The driver holds the weights, slots x labels numbers.  The order of sentences is by their content, so
    reruns agree; more than ``LABELS`` pairs of tag and type are an error.
    """
    pairs = sentences.select(F.explode(F.arrays_zip("tags", "types")).alias("p")).select("p.*").distinct()
    found = [tuple(r) for r in pairs.limit(LABELS + 1).collect()]
    if len(found) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    labels = sorted(found, key=lambda p: tuple((x is not None, x or "") for x in p)) or [(None, None)]
    key = F.xxhash64("words", "tags", "types")
    dealt = sentences.select("words", "tags", "types").filter(F.size("words") > 0).repartition(shards, key)
    rows = materialize(dealt.sortWithinPartitions(key, F.to_json("words")), "sentences")
    size, width = slots * len(labels), len(labels)
    weights, mean = np.zeros(size + (width + 1) * width), np.zeros(size + (width + 1) * width)
    for _ in range(rounds):
        now = Tagger(labels, weights[:size].reshape(slots, width), weights[size:].reshape(width + 1, width))
        got = _share(rows, now).toArrow()
        code = got.column("code").to_numpy()
        tasks = got.column("change").to_numpy()[code < 0].sum() or 1.0
        at = code[code >= 0]
        mean += weights
        mean[at] += got.column("mean").to_numpy()[code >= 0] / tasks
        weights = weights.copy()
        weights[at] += got.column("change").to_numpy()[code >= 0] / tasks
    mean /= max(rounds, 1)
    return Tagger(labels, mean[:size].reshape(slots, width), mean[size:].reshape(width + 1, width))


def tagged_by(tagger: Tagger) -> TokenProvider:
    """A token provider: runs of word characters with their tags and entity types by sentence.

    The tagger travels with the tasks; its size is that of its weights.  Null and empty texts have no tokens.
    """
    slim = Tagger(tagger.labels, tagger.emit.astype(np.float32), tagger.moves.astype(np.float32))

    def provider(df: DataFrame, text: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (text, "text")]
        lines = F.regexp_replace(F.concat(F.lit("\n"), sentence_lines(text)), rf"\n[^{WORD}\n]+", "\n")
        raw = F.regexp_extract_all(lines, F.lit(f"(\n?{RUN})(?:'{RUN})?"), F.lit(1))
        shared = df.sparkSession.sparkContext.broadcast(slim)
        names = [f"_{i}" for i in range(len(rest))]
        split = df.select(*rest, raw.alias("_raw")).toDF(*names, "_raw")
        token = pa.struct([("text", pa.string()), ("label", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    marked = batch.column(len(names))[i].as_py() or []
                    words = [w.removeprefix("\n") for w in marked]
                    starts = [k for k, w in enumerate(marked) if k == 0 or w.startswith("\n")]
                    sentences = [words[a:b] for a, b in zip(starts, [*starts[1:], len(words)])]
                    labels = np.concatenate([np.zeros(0, np.int64), *own.label(sentences)])
                    found = [[{"text": w, "label": int(n)} for w, n in zip(words, labels)]]
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(j).slice(i, 1) for j in range(len(names))], pa.array(found, pa.list_(token))],
                        names=[*names, "_tokens"],
                    )

        schema = ", ".join([*(f"{n} {split.schema[n].dataType.simpleString()}" for n in names), "_tokens array<struct<text: string, label: int>>"])
        tokens = explode_with_pos(split.mapInArrow(run, schema).toDF(*rest, "_tokens"), F.col("_tokens"), "pos", "_t")
        pick = lambda part: F.get(F.array(*[F.lit(p[part]).cast("string") for p in slim.labels]), F.col("_t.label"))
        return tokens.select(*rest, "pos", F.col("_t.text").alias("text"), pick(0).alias("tag"), pick(1).alias("ent_type"))

    return provider
