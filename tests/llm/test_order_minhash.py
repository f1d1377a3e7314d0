import hashlib
import random

from quillspark.llm import order_minhash as O
from tests.llm.helpers import awkward, clashing, documents, empty

rng = random.Random(2)
WORDS = [f"word{i}" for i in range(5000)]


def test_edits_and_neighbours(spark):
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 300))) + "é" * (k % 3) for k in range(120)]
    texts[50] = texts[20]
    got = {r.doc_id: r for r in O.fingerprints(documents(spark, texts), buckets=7).collect()}
    for i, text in enumerate(texts):
        follow, cut = texts[(i + 1) % len(texts)], len(text) // 4
        edited = text[: len(text) - cut] + follow[:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[50].fingerprint == got[20].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len(set(texts))
    long = [r for i, r in got.items() if len(texts[i].split()) > 100]
    assert sum(r.near_edited for r in long) / len(long) > 0.2 and sum(r.near_next for r in long) / len(long) < 0.05


def sketch(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return {r.i: r.p for r in O.add_fingerprint(df, "text", "p").collect()}


def shared(a, b):
    return len(set(a) & set(b)) / len({e[:2] for e in a + b})


def test_order_and_repeats_matter(spark):
    """Swapped blocks keep nearly all k-mers, but pairs across them change order; a repeated text is no equal."""
    words = [rng.choice(WORDS) for _ in range(600)]
    swapped = words[300:] + words[:300]
    p = sketch(spark, " ".join(words), " ".join(swapped), " ".join(words * 2), " ".join(words[:-3]))
    assert shared(p[0], p[1]) < 0.8 and shared(p[0], p[3]) > 0.85 and p[0] != p[2]


def test_smallest_are_found_beyond_the_first_cut(spark, monkeypatch):
    text = " ".join(rng.choice(WORDS) for _ in range(900))
    want = sketch(spark, text)[0]
    for kept in (8, 40, 100_000):
        monkeypatch.setattr(O, "KEPT", kept)
        assert sketch(spark, text)[0] == want


def test_no_python_in_the_plan(spark, capsys):
    O.fingerprints(documents(spark, ["a b c"] * 5)).explain()
    assert "Python" not in (out := capsys.readouterr().out) and "Arrow" not in out


def test_awkward(spark):
    docs = awkward(spark)
    rows = O.fingerprints(clashing(docs, "print", "fingerprint")).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == "" and by[2].near_next == 1.0 and by[1].n_chars == 0
    assert O.fingerprints(empty(spark)).count() == 0
    one = O.fingerprints(documents(spark, ["abcdefgh"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
