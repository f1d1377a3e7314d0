"""Small tables with the awkward cases every operator has to take."""

import public_tokenizers
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [
        (i, t, "en", (sources or ["s"])[k % len(sources or ["s"])], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    rows = [
        (None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "a", 0), (3, " \n\t ", "en", "a", 4),
        (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (4, "another text of the same id", "en", "b", 27),
        (5, "word " * 30_000, "en", "b", 150_000), (6, "x" * 70_000, "en", None, 70_000),
        (None, "a text without an id but with words", "en", "c", 35), (7, "Élan vital, ÀÉÎ… 中文 ünd", "fr", "c", 24),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def clashing(df, *names):
    """The rows with extra columns that have the names of results."""
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df
