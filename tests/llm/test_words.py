import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quillspark.llm import words as W


def test_numbers_follow_words(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 64)
    rng = random.Random(1)
    texts = [None, "", "  ", "a", "Ab aB", "x" * 300 + " y " + "z" * 200]
    texts += ["".join(rng.choice("ab Cé\n\t\x0b,\xa0") for _ in range(rng.randint(0, 300))) for _ in range(100)]
    numbers, first = W.word_numbers(*W.raw(pa.array(texts)))
    seen = {}
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        own = numbers[first[i] : first[i + 1]].tolist()
        assert len(own) == len(words)
        assert all(seen.setdefault(w, n) == n for w, n in zip(words, own))
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    texts = ["a b c d e f", "a b c d e a b c d e", "a b", "b a", "", "a a a a a a"]
    sets = list(W.shingle_sets(*W.word_numbers(*W.raw(pa.array(texts)))))
    assert [len(s) for s in sets] == [2, 5, 1, 1, 0, 1]
    assert len(np.intersect1d(sets[0], sets[1])) == 1 and sets[2] != sets[3]


def test_spans_cover_all_rows():
    offsets = np.cumsum([0, 5, 0, 100, 3, 3, 0])
    spans = list(W.spans(offsets, 10))
    assert spans[0][0] == 0 and spans[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_few_values_are_held_at_a_time():
    texts = pa.array([("x" * 99 + " ") * 10_000] * 4)
    data, offsets = W.raw(texts)
    W.word_numbers(data, offsets)  # fills the tables that stay
    tracemalloc.start()
    W.word_numbers(data, offsets)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 16 << 20


def test_tidy_gives_memory_back_after_the_last_batch(monkeypatch):
    told = []
    monkeypatch.setattr(W, "release", lambda: told.append(True))
    batches = W.tidy(lambda rows: (r for r in rows))(iter([1, 2]))
    assert [next(batches), next(batches), told] == [1, 2, []]
    assert list(batches) == [] and told == [True]


def test_release_runs():
    W.release()
