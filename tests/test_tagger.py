"""The tagger against all label sequences, and entity types that follow it into the review list."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import tagger as T
from quillspark.operators import vocab

FRAMES = {
    "PERSON": [("yesterday", "NN", None), ("mister", "NN", None), None, ("walked", "VBD", None), ("home", "NN", None)],
    "GPE": [("they", "PRP", None), ("lived", "VBD", None), ("in", "IN", None), None, ("then", "RB", None)],
    "ORG": [("the", "DT", None), ("firm", "NN", None), None, ("hired", "VBD", None), ("people", "NNS", None)],
    "LANGUAGE": [("she", "PRP", None), ("speaks", "VBZ", None), None, ("well", "RB", None)],
}
TOKENS = "sentence long, pos int, text string, tag string, ent_type string"


def name(own):
    return "".join(own.choice("bdfgklmnprst") + own.choice("aeiou") for _ in range(3)).capitalize()


def sentences(number, seed):
    own, out = random.Random(seed), []
    for _ in range(number):
        kind = own.choice(sorted(FRAMES))
        out.append([t or (name(own), "NNP", kind) for t in FRAMES[kind]])
    return out


def token_rows(spark, made):
    return spark.createDataFrame([(i, k, *t) for i, s in enumerate(made) for k, t in enumerate(s)], TOKENS).repartition(4)


@pytest.fixture(scope="module")
def fitted(spark):
    return T.fit(T.labelled_sentences(token_rows(spark, sentences(300, 1))), rounds=4, shards=3, slots=1 << 13)


def test_paths_equal_those_of_all_sequences():
    gen = np.random.default_rng(2)
    moves = gen.standard_normal((4, 3))
    scores = [gen.standard_normal((n, 3)) for n in (3, 0, 5, 1, 5, 4)]

    def value(s, path):
        steps = [moves[a, b] for a, b in zip((3, *path[:-1]), path)]
        return sum(steps) + sum(s[k, x] for k, x in enumerate(path))

    for s, got in zip(scores, T.best_paths(scores, moves)):
        want = max(itertools.product(range(3), repeat=len(s)), key=lambda p: value(s, p))
        assert tuple(got) == want
    assert T.best_paths([], moves) == []


def test_labels_of_new_names(spark, fitted):
    made = sentences(200, 2)
    got = fitted.label([[t[0] for t in s] for s in made])
    right = [fitted.labels[n] == t[1:] for s, path in zip(made, got) for t, n in zip(s, path)]
    assert np.mean(right) > 0.97


def test_reruns_agree_whatever_the_partitions(spark, fitted):
    again = T.fit(T.labelled_sentences(token_rows(spark, sentences(300, 1)).repartition(7)), rounds=4, shards=3, slots=1 << 13)
    assert again.labels == fitted.labels and np.allclose(again.emit, fitted.emit) and np.allclose(again.moves, fitted.moves)


def test_first_label_of_each_word_follows_the_types(spark, fitted):
    """A3 and J4 with several types, against the tokens one by one."""
    own, chapters = random.Random(4), []
    names = [name(own) for _ in range(12)]
    for index in range(5):
        lines = []
        for _ in range(20):
            kind, who = own.choice(sorted(FRAMES)), own.choice(names)
            lines.append(" ".join(t[0] if t else who for t in FRAMES[kind]).capitalize().replace(who.lower(), who) + ".")
        chapters.append((1, index, " ".join(lines)))
    df = spark.createDataFrame([*chapters, (1, 5, None), (1, 6, "")], "book_id long, index int, text string")
    tokens = vocab.tokens(df, "text", T.tagged_by(fitted))
    assert tokens.columns == ["book_id", "index", "pos", "text", "tag", "ent_type"]
    order = lambda r: (r["index"], r.pos)
    rows = sorted(tokens.collect(), key=order)
    assert [r.text for r in rows] == [r.text for r in sorted(vocab.tokens(df).collect(), key=order)]
    assert {r.ent_type for r in rows} - {None} == set(FRAMES) and "VBD" in {r.tag for r in rows}
    want = {}
    for r in rows:
        if r.ent_type in vocab.NAME_TYPES:
            want.setdefault(r.text.lower(), r.ent_type)
    nothing = spark.createDataFrame([], "word string")
    review = vocab.oov(tokens, nothing, spark.createDataFrame([], "word string, zipf double"))
    got = {r.word.lower(): r.label for r in review.collect() if r.label != vocab.RARE}
    assert got == {w: t for w, t in want.items() if len(w) > 1} and len(set(got.values())) >= 3


def test_awkward_training_tables(spark):
    none = T.fit(T.labelled_sentences(spark.createDataFrame([], TOKENS)), rounds=1, slots=64)
    assert none.labels == [(None, None)]
    texts = spark.createDataFrame([(1, "A word. Another!"), (2, None)], "tag long, text string")
    rows = vocab.tokens(texts.withColumnRenamed("tag", "id"), "text", T.tagged_by(none)).collect()
    assert [(r.text, r.tag, r.ent_type) for r in rows] == [("A", None, None), ("word", None, None), ("Another", None, None)]
    odd = [(None, 0, "x", "NN", None), (1, 0, None, "NN", None), (1, 1, "", None, ""), (2, 0, "y" * 5000, "NN", "ORG"), (2, 0, "y", "NN", "ORG")]
    long = [(3, k, "w", "NN", None) for k in range(3 * T.PIECE)]
    made = T.labelled_sentences(spark.createDataFrame([*odd, *long], TOKENS))
    assert sorted(len(r.words) for r in made.collect()) == [1, 2, *[T.PIECE] * 3]
    assert set(T.fit(made, rounds=1, slots=64).labels) == {(None, None), ("NN", None), ("NN", "ORG")}
    many = made.sparkSession.range(T.LABELS + 1).select(F.array(F.lit("w")).alias("words"), F.array(F.col("id").cast("string")).alias("tags"), F.array(F.lit(None).cast("string")).alias("types"))
    with pytest.raises(ValueError):
        T.fit(many)
