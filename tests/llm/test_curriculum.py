import pytest
from pyspark.sql import functions as F

from quillspark.llm import curriculum as C
from tests.llm.helpers import awkward, clashing, documents, empty


def brute_targets(sizes, weights):
    """Pour the total in small shares until nobody can take more."""
    caps, out, left = [2 * s for s in sizes], [0.0] * len(sizes), min(1.5 * sum(sizes), 2 * sum(sizes))
    for _ in range(200_000):
        free = [i for i, c in enumerate(caps) if out[i] < c]
        if left <= 1e-9 or not free:
            break
        step = left / sum(weights[i] for i in free)
        step = min(step, min((caps[i] - out[i]) / weights[i] for i in free))
        for i in free:
            out[i] += step * weights[i]
            left -= step * weights[i]
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 10, 5], [0, 0, 7], [5], [3, 3, 3, 900, 1, 1, 40]])
def test_targets(sizes):
    weights = [C.CYCLE[i % 3] for i in range(len(sizes))]
    got = C.targets(sizes, weights, 1.5, 2)
    assert got == pytest.approx(brute_targets(sizes, weights)) and sum(got) == pytest.approx(1.5 * sum(sizes))


def test_plan(spark):
    texts = [" ".join(["w"] * (1 + k % 17)) for k in range(600)]
    docs = documents(spark, texts, sources=["b", "a", "a", "c", None, "d"])
    rows = C.plan(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == 600
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert all(0 <= r.taken <= 2 * r.size and all(0 <= p <= 1 for p in r.positions) for r in own)
        assert all((r.taken > 0) == (len(r.positions) > 0) for r in own)
    again = {r.doc_id: (r.taken, r.positions) for r in C.plan(docs.repartition(7)).collect()}
    assert again == {r.doc_id: (r.taken, r.positions) for r in rows}


@pytest.mark.parametrize("knots", [((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 0.0)), ((0.0, 0.0), (0.3, 0.0), (1.0, 3.0))])
def test_positions_invert_the_demand(spark, knots):
    docs = documents(spark, ["w " * 10] * 50)
    got = C.plan(docs, weights={"s": 1.0}, schedules={"s": knots}, share=1.0).filter("size(positions) > 0")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))

    def demand(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            if t > t0:
                e = min(t, t1)
                total += (e - t0) * (w0 + w0 + (w1 - w0) * (e - t0) / (t1 - t0)) / 2
        return total / area

    at = sorted(r.positions[0] for r in got.collect())
    assert [demand(t) for t in at] == pytest.approx([k / 50 for k in range(50)], abs=1e-6)


def test_mix_repeats_and_orders(spark):
    docs = documents(spark, [f"text {k} " * (k % 5) for k in range(200)], sources=["a", "b", "c"])
    plan = {r.doc_id: len(r.positions) for r in C.plan(docs).collect()}
    mixed = C.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in plan.items() if n}


def test_awkward(spark):
    docs = awkward(spark)
    rows = C.plan(clashing(docs, "size", "target")).collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r.size for r in rows)
    mixed = C.mix(docs)
    assert mixed.count() == sum(len(r.positions) for r in rows)
    assert C.plan(empty(spark)).count() == 0 and C.mix(empty(spark)).count() == 0
    two = spark.createDataFrame([(1, "a\x0bb\x1cc\xa0d", None)], "doc_id long, text string, source string")
    assert two.select(C.word_count(F.col("text"))).first()[0] == 2


def test_plan_starts_no_python_workers(spark):
    docs = documents(spark, ["one two", "three", "four five six"], sources=["a", None, "b"])
    assert "ExistingRDD" not in C.plan(docs)._jdf.queryExecution().toString()
