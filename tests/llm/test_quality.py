import numpy as np
import pyarrow as pa

from quillspark.llm import quality as Q
from quillspark.llm.words import raw
from tests.llm.helpers import awkward, clashing, documents, empty

LABELS = "doc_id long, quality int, toxic int"


def walk(forest, x):
    total = forest.base
    for node in forest.roots:
        while forest.left[node] >= 0:
            node = forest.left[node] + (x[forest.feature[node]] > forest.cut[node])
        total += forest.value[node]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = Q.fit(x, y, trees=20)
    got = forest.score(x)
    assert np.allclose(got, [walk(forest, r) for r in x])
    assert ((got > 0.5) == (y == 1)).mean() > 0.97


def test_few_or_equal_labels():
    assert Q.fit(np.zeros((0, 3)), np.zeros(0)).score(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert (Q.fit(np.ones((4, 3)), np.ones(4)).score(np.ones((2, 3))) > 0.5).all()


def test_statistics_cover_whole_texts():
    texts = ["", "good words here. " * 10, "good words here. " * 10 + "@" * 100]
    x = Q.statistics(*raw(pa.array(texts)))
    assert not x[0].any() and (x[1] != x[2]).any() and np.isfinite(x).all()


def test_learns_and_keeps_rows(spark):
    good = ["The plain sentence number %d goes on with words." % i for i in range(60)]
    bad = ["BUY!! NOW!! %d ### $$$ |||" % i for i in range(60)]
    docs = documents(spark, good + bad)
    rows = [(i, int(i < 60), 0) for i in range(120)] + [(0, None, 0), (None, 1, 0), (3, 1, 0)]
    got = Q.classify(docs, spark.createDataFrame(rows, LABELS)).collect()
    assert len(got) == 120
    assert all((r.score >= Q.THRESHOLD) == (r.doc_id < 60) for r in got)


def test_awkward(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0)], LABELS)
    got = Q.classify(clashing(awkward(spark), "score"), labels)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert Q.classify(empty(spark), empty(spark, LABELS)).count() == 0
