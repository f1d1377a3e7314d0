import random

import numpy as np

from quillspark.llm import lsi
from tests.llm.helpers import awkward, clashing, documents, empty

rng = random.Random(9)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
COMMON = ["the", "of", "and", "to", "in", "is"]


def prose(n, seed):
    own = random.Random(seed)
    return [own.choice(COMMON) if own.random() < 0.4 else own.choice(VOCABULARY) for _ in range(n)]


ITEMS = [" ".join(prose(30 + k, 1000 + k)) for k in range(12)]


def bench(spark, items=ITEMS):
    return spark.createDataFrame([*enumerate(items), (99, None), (None, "x y"), (98, "")], "item_id long, text string")


def test_copies_and_paraphrases_are_found(spark):
    texts = [" ".join(prose(150, k)) for k in range(60)]
    for k, item in enumerate(ITEMS):
        words = item.split()
        if k % 2:
            own = random.Random(k)
            words = [own.choice(VOCABULARY) if own.random() < 0.15 else w for w in words]
            words[3:5] = words[4], words[3]
        texts[k] = " ".join(prose(70, k)) + " " + " ".join(words).upper() + ". " + " ".join(prose(80, k + 500))
    docs = documents(spark, texts)
    got = {(r.doc_id, r.item_id) for r in lsi.contaminated(docs, bench(spark)).collect()}
    assert got == {(k, k) for k in range(len(ITEMS))}
    hits = lsi.find_items(clashing(docs, "hits"), bench(spark))
    assert hits.count() == len(texts) and len(set(hits.columns)) == len(hits.columns)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lsi, "BLOCK_ITEMS", 5)
    docs = documents(spark, [" ".join(prose(40, k)) + " " + ITEMS[k] for k in range(12)])
    assert {(r.doc_id, r.item_id) for r in lsi.contaminated(docs, bench(spark)).collect()} == {(k, k) for k in range(12)}


def test_candidates_against_all_cosines(spark, monkeypatch):
    """Recall of the latent search over passages that keep from none to all of an item's words, by full TF-IDF vectors."""
    monkeypatch.setattr(lsi, "COMMON", 0.0)
    monkeypatch.setattr(lsi, "ANSWERED", 0)
    own, texts = random.Random(3), []
    for k in range(120):
        item = ITEMS[k % len(ITEMS)].split()
        keep = k / 119
        texts.append(" ".join(w if own.random() < keep else own.choice(VOCABULARY) for w in item))
    docs = documents(spark, texts)
    idf = {w: np.log(121 / (1 + sum(w in t.split() for t in texts))) + 1e-3 for t in [*texts, *ITEMS] for w in t.split()}

    def vector(words):
        return {w: words.count(w) * idf[w] for w in set(words)}

    def cosine(a, b):
        norm = np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / norm

    items = [vector(i.split()) for i in ITEMS]
    want = {(k, i) for k, t in enumerate(texts) for i, v in enumerate(items) if cosine(vector(t.split()), v) >= 0.6}
    got = {(r.doc_id, r.item_id) for r in lsi.contaminated(docs, bench(spark)).collect()}
    assert len(want) >= 25 and len(want & got) >= 0.9 * len(want)


def test_longest_common_subsequence():
    assert lsi.common_words(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 1])) == 2
    assert lsi.common_words(np.array([1]), np.array([], dtype=int)) == 0


def test_randomised_svd(spark):
    gen = np.random.default_rng(4)
    dense = (gen.random((200, 30)) < 0.2) * (1 + gen.random((200, 30)))
    rows = [([int(i) for i in np.flatnonzero(r)], [float(x) for x in r[r > 0]]) for r in dense]
    df = spark.createDataFrame(rows, "terms array<int>, weights array<double>").repartition(3)
    space = lsi.latent_space(df, 30, rank=8, rounds=6)
    unit = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    _, s, _ = np.linalg.svd(unit)
    assert np.allclose(np.linalg.norm(unit @ space, "fro"), np.sqrt((s[:8] ** 2).sum()), rtol=0.02)


def test_space_is_fitted_on_all_passages(spark, monkeypatch):
    """Every passage counts, together as much as the items; the space holds what the exact one would."""
    texts = [" ".join(prose(44 * (1 + k % 7), 300 + k)) for k in range(400)]
    fits, fit = [], lsi.latent_space

    def kept(rows, terms, **options):
        space = fit(rows, terms, 40, 8, **options)
        fits.append((rows.collect(), space))
        return space

    monkeypatch.setattr(lsi, "latent_space", kept)
    assert lsi.contaminated(documents(spark, texts), bench(spark)).count() == 0
    ((rows, space),) = fits

    known = sorted({w for i in ITEMS for w in i.split()})
    idf = {w: np.log(401 / (1 + sum(w in t for t in map(set, map(str.split, texts))))) + 1e-3 for w in known}
    passages = [t.split()[k : k + 44] for t in texts for k in range(0, len(t.split()), 44)]
    some = sum(any(w in idf for w in p) for p in passages)
    assert len(passages) > 1500 and len(rows) == some + len(ITEMS)

    def unit(words):
        v = np.array([words.count(w) * idf[w] for w in known])
        return v / max(np.linalg.norm(v), 1e-12)

    a, b = np.array([unit(p) for p in passages]), np.array([unit(i.split()) for i in ITEMS])
    exact = np.linalg.eigvalsh(a.T @ a * 200 / len(passages) + b.T @ b)[::-1]
    numbers = [int(lsi._words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for w in known]
    c = space[np.argsort(np.argsort(numbers))]
    held = np.trace(c.T @ (a.T @ (a @ c) * 200 / len(passages) + b.T @ (b @ c)))
    assert held >= 0.99 * exact[:40].sum()


def test_awkward(spark):
    docs = awkward(spark)
    assert lsi.find_items(docs, bench(spark)).count() == docs.count()
    short = bench(spark, ["one", "another text of the same id"])
    got = {(r.doc_id, r.item_id) for r in lsi.contaminated(docs, short).collect()}
    assert got == {(4, 0), (4, 1)}
    assert lsi.contaminated(empty(spark), bench(spark)).count() == 0
    assert lsi.contaminated(docs, empty(spark, "item_id long, text string")).count() == 0


def planted(kind, length, number):
    """Texts of 140 words around an item of ``length`` words, and the items."""
    texts, items = [], []
    for k in range(number):
        item = prose(length, 7000 + 31 * length + k)
        items.append(" ".join(item))
        own = random.Random(k)
        if kind == "paraphrase":
            item = [own.choice(VOCABULARY) if own.random() < 0.15 else w for w in item]
        texts.append(" ".join([*prose(70, 90_000 + k), *item, *prose(70, 95_000 + k)]))
    return texts, items


def test_short_items_inside_long_texts(spark):
    """Every verbatim item of one to seven words, against a search of all places by hand."""
    texts, items = [], []
    for length in range(1, 8):
        more = planted("copy", length, 40)
        texts, items = texts + more[0], items + more[1]
    items += items[:3]  # items of one text
    words = [t.split() for t in texts]
    want = set()
    for i, item in enumerate(items):
        own = item.split()
        for d, text in enumerate(words):
            if any(text[k : k + len(own)] == own for k in range(len(text) - len(own) + 1)):
                want.add((d, i))
    assert len(want) >= 280
    docs = documents(spark, texts)
    hits = lsi.contaminated(docs, bench(spark, items)).filter(f"item_id < {len(items)}").collect()
    assert {(r.doc_id, r.item_id) for r in hits} == want
    for r in hits:
        own = items[r.item_id].split()
        assert words[r.doc_id][r.word : r.word + len(own)] == own and (r.common, r.cosine) == (1.0, 1.0)


def test_a_sequence_does_not_cross_texts():
    numbers, first = np.array([1, 2, 3, 4], dtype=np.uint64), np.array([0, 2, 2, 4])
    find = lsi.Sequences([np.array([2, 3], dtype=np.uint64), np.array([3, 4], dtype=np.uint64), np.array([3], dtype=np.uint64)])
    assert sorted(find(numbers, first)) == [(2, 1, 2), (2, 2, 2)]


def test_recall_by_length(spark):
    """Copies and paraphrases of items from 8 to 400 words."""
    for kind, least in (("copy", 1.0), ("paraphrase", 0.9)):
        texts, items = [], []
        for length in (8, 15, 45, 100, 200, 400):
            more = planted(kind, length, 20)
            texts, items = texts + more[0], items + more[1]
        got = {(r.doc_id, r.item_id) for r in lsi.contaminated(documents(spark, texts), bench(spark, items)).collect()}
        assert sum((k, k) in got for k in range(len(items))) >= least * len(items), kind
