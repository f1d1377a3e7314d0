"""Ranked lexical search against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import dual_tree as M
from tests.llm.helpers import awkward, clashing, documents, empty

ITEMS = "item_id long, text string"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in held if t), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in held:
            score = 0
            for w in set(terms(text)) & set(t):
                m = 50 + (50 * len(t) * n_docs) // n_terms
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=50):
    return sorted(map(tuple, M.rank(docs, items, k).collect()), key=str)


def corpus(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("k", [3, 50])
def test_equals_brute_force(spark, k):
    """Skewed words, a third of all documents alike, and more items than a node has."""
    texts = corpus(1, 300, 80)
    texts += [texts[0]] * 150
    items = [(i, t) for i, t in enumerate(corpus(2, 40, 90))]
    docs = documents(spark, texts)
    got = run(spark, docs, spark.createDataFrame(items, ITEMS), k)
    assert got == brute(list(enumerate(texts)), items, k)


def test_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(M, "ENTRIES", 20)
    monkeypatch.setattr(M, "ITEM_BLOCK", 8)
    texts, items = corpus(3, 60, 30), [(i % 7, t) for i, t in enumerate(corpus(4, 12, 30))]
    got = run(spark, documents(spark, texts), spark.createDataFrame(items, ITEMS).coalesce(2))
    assert got == brute(list(enumerate(texts)), items, 50)


def test_bounds_prune_and_lose_nothing():
    """Few of the pairs are scored when documents fall into kinds, and the best are those of scoring all."""
    rng = np.random.default_rng(5)
    kinds, docs = 40, 2048
    rows = [np.unique(np.r_[rng.integers(0, 8, 4) + 8 * (d * kinds // docs), rng.integers(320, 330, 2)]) for d in range(docs)]
    ends, flat = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows)
    values = rng.integers(1, 1000, len(flat))
    own = [np.arange(8 * i, 8 * i + 8) for i in range(kinds)]
    item_ends, item_terms = np.append(0, np.cumsum([8] * kinds)), np.concatenate(own)
    weights = rng.integers(1, 1000, len(item_terms))
    order, levels = M.item_tree(item_ends, item_terms, weights)
    search, scored = M._Search(levels, np.zeros(kinds, np.int64), 330, 5), [0]
    plain = search._score
    search._score = lambda a, b, items: (scored.__setitem__(0, scored[0] + (b - a) * len(items)), plain(a, b, items))
    search.chunk(np.arange(docs), np.zeros(docs, np.int64), ends, flat, values)
    search.choose()
    dense = np.zeros((docs, 330), np.int64)
    dense[np.repeat(np.arange(docs), np.diff(ends)), flat] = values
    for n, item in enumerate(order):
        w = np.zeros(330, np.int64)
        w[own[item]] = weights[8 * item : 8 * item + 8]
        scores = dense @ w
        best = np.lexsort((np.arange(docs), -scores))[:5]
        mine = search.best[0] == n
        assert search.best[3][mine].tolist() == best.tolist() and search.best[1][mine].tolist() == scores[best].tolist()
    assert scored[0] < 0.1 * docs * kinds


def test_awkward_tables(spark):
    docs = clashing(awkward(spark), "score", "rank", "item", "top", "n")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "one WORD ünd"), (2, None), (3, " ,.! "), (None, "text"), (1, "one WORD ünd"), (5, "absent")]
    frame = clashing(spark.createDataFrame(items, ITEMS), "doc_id", "score")
    assert run(spark, docs, frame) == brute(rows, items, 50)
    for d, i in ((empty(spark), frame), (docs, empty(spark, ITEMS)), (docs.filter("text is null"), frame)):
        assert M.rank(d, i).count() == 0
    assert M.rank(docs, frame.withColumn("text", F.lit(None).cast("string"))).count() == 0
