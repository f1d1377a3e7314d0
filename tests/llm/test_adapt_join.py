import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import adapt_join as A
from quillspark.llm.components import components
from tests.llm.helpers import awkward, clashing, documents, empty


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, n, component) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and 100 * both >= 80 * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    out = []
    for i, (own, _) in enumerate(rows):
        ids = [r for j, (r, _) in enumerate(rows) if find(j) == find(i) and r is not None]
        out.append((own, len(sets[i]), min(ids, default=None)))
    return out


def same(df, rows):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in A.near_duplicates(df).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    """Families of near copies around the threshold, chains, shared passages and copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [" ".join(passage + [rng.choice(words) for _ in range(rng.choice([4, 10, 60]))]) for _ in range(15)]
    texts += [texts[0]] * 3 + [texts[5].upper()] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    same(documents(spark, texts), rows)


@pytest.mark.parametrize("seed", range(2))
def test_insertions_and_deletions(spark, seed):
    """Pairs of J 0.80 to 0.90 where one text has words more, at its end, its start or amid; a third shares its tail."""
    rng = random.Random(100 + seed)
    texts = []
    for f in range(60):
        base = [f"f{f}w{i}" for i in range(104)]
        more = [f"f{f}x{i}" for i in range(rng.randint(11, 25) - (4 if f % 3 == 2 else 0))]
        at = (len(base), 0, rng.randrange(20, 80))[f % 3]
        longer = base[:at] + more + base[at:]
        texts += [" ".join(base), " ".join(longer)]
        if f % 2:
            texts.append(" ".join(longer[:-12] if f % 4 == 1 else longer[12:]))
    sets = [shingles(t) for t in texts]
    assert sum(0.8 <= len(a & b) / len(a | b) < 0.91 for i, a in enumerate(sets) for b in sets[:i]) >= 60
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    same(documents(spark, [t for _, t in rows]), rows)


def test_chain(spark):
    """Ends of a chain of alike neighbours are one component."""
    base = [f"c{i}" for i in range(120)]
    rows = []
    for k in range(8):
        own = list(base)
        for j in range(k):
            own[10 + 12 * j] = f"x{j}"
        rows.append((k, " ".join(own)))
    same(documents(spark, [t for _, t in rows]), rows)
    assert {r[2] for r in brute(rows)} == {0}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=40), st.sets(st.integers(0, 60), min_size=1, max_size=40))
def test_prefixes_of_alike_sets_share_enough(a, b):
    level = np.random.default_rng(1).integers(0, 6, 2 << A.SKETCH_BITS).astype(np.int8)
    spread = np.random.default_rng(2).integers(0, 2**63, 61, dtype=np.uint64)
    x, y = (np.sort(spread[list(s)]) for s in (a, b))
    both = len(a & b)
    if 100 * both >= 80 * len(a | b):
        (p, l), (q, m) = A.prefix(x, level), A.prefix(y, level)
        assert len(np.intersect1d(p, q)) >= min(l, m)


def test_awkward(spark):
    docs = awkward(spark)
    same(clashing(docs, "n", "key"), [(r.doc_id, r.text) for r in docs.collect()])
    assert A.near_duplicates(empty(spark)).count() == 0


def test_null_ids_are_linked(spark):
    text = " ".join(f"w{i}" for i in range(80))
    other = text.replace("w79", "end")
    rows = [(None, text), (None, other), (5, "something else"), (9, text + " more")]
    same(documents(spark, [t for _, t in rows], [i for i, _ in rows]), rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 150), (150, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[200] == 150
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
