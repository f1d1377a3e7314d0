"""One source, word or title holds a third of all rows; results stay whole."""

import pytest
from pyspark.sql import functions as F

from quillspark.api import chapters
from quillspark.operators import lexicon, scale, timeline, vocab
from quillspark.session import ship

N = 3_000


@pytest.fixture(scope="module")
def shelf(spark):
    """A hot book with a third of the chapters, each text full of one hot word."""
    hot = F.col("id") % 3 == 0
    return spark.range(N).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 97)).alias("book_id"),
        F.col("id").cast("int").alias("index"),
        F.concat(F.lit("So Morlock met Morlock. Word"), F.col("id"), F.lit(" is here.")).alias("text"),
    )


def window_sizes(df, group, width):
    """Largest group a window over (group, bucket) would meet."""
    return df.groupBy(*group, F.expr(f"index div {width}")).count().agg(F.max("count")).first()[0]


def test_marks_of_a_hot_book(spark, shelf):
    timed = shelf.withColumn("title", F.lit("t")).withColumn("seconds", F.lit(0.001))
    got = timeline.marks(timed, width=100).filter("book_id = 'hot'").orderBy("index").collect()
    assert [r.start_ms for r in got] == list(range(N // 3))
    assert window_sizes(shelf, ["book_id"], 100) <= 100


def test_vocabulary_of_a_hot_word(spark, shelf):
    stats = vocab.spelling_stats(vocab.tokens(shelf), ["book_id"])
    total = stats.filter("text = 'Morlock'").agg(F.sum("n")).first()[0]
    assert total == 2 * N
    plan = stats._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


@pytest.mark.parametrize("ship_rows", [10, 0])
def test_rewrite_of_a_hot_word(spark, shelf, ship_rows):
    ship(spark)
    lex = spark.createDataFrame([("morlock", "M")], "word string, ipa string")
    out = lexicon.apply_lexicon(shelf, "text", lex, ["book_id", "index"], ship_rows=ship_rows)
    assert out.filter(F.col("text").startswith("So [Morlock](/M/) met [Morlock](/M/).")).count() == N


def test_affected_and_examples_by_a_hot_word(spark, shelf, monkeypatch):
    # Every join takes the route for sides too large to broadcast.
    monkeypatch.setattr(scale, "fits_broadcast", lambda *a: False)
    words = spark.createDataFrame([("morlock",), ("word7",)], "word string")
    chunked = shelf.withColumn("chunks", F.array("text"))
    assert lexicon.affected(chunked, words).count() == N
    rows = shelf.select("index", F.lit(0).alias("n"), F.col("text").alias("chunk"))
    got = {r.word: r.sentence for r in lexicon.example_sentence(rows, words, book=[]).collect()}
    assert got == {"morlock": "So Morlock met Morlock.", "word7": "Word7 is here."}


def test_numbering_of_a_hot_book(spark):
    ship(spark)
    spine = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("book_id"),
        (F.col("id") * 1_000).alias("pos"), F.lit("c.xhtml").alias("name"),
        F.when(F.col("id") % 2 == 0, "<p>x</p>").otherwise("<div>x</div>").alias("html"),
    )
    got = chapters(spine).filter("book_id = 'hot'").orderBy("pos").collect()
    assert [r["index"] for r in got] == list(range(100))
