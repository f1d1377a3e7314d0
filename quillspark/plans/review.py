"""The reviewer's loop: listen to proposals, commit the approved ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import Settings, rooted
from quillspark.operators import lexicon
from quillspark.operators.synth import Synthesizer, synthesize
from quillspark.plans.render import chunk_table, lexicon_of
from quillspark.sources import artifacts
from quillspark.sources.store import Store


def samples(
    spark: SparkSession, store: Store, reviewed: DataFrame, backend: Synthesizer
) -> DataFrame:
    """Audio of each proposed word in a sentence from its book, with and without override.

    ``reviewed`` has (book_id, word, ipa, ...), as edited by the reviewer.  A sample that could not be
    made has null audio and its ``error``.
    """
    version = store.new_version(spark)
    todo = lexicon.proposed(reviewed)
    sentences = lexicon.example_sentence(
        chunk_table(store.read(spark, "chunks")), todo.select("book_id", "word")
    )
    lines = lexicon.variants(todo.select("book_id", "word", "ipa").join(sentences, ["book_id", "word"]))
    audio = synthesize(lines.select("book_id", "word", "variant", "input"), backend, "input")
    store.write(audio, "samples", version)
    books = artifacts.one_per_slug(store.read(spark, "books"))
    artifacts.write_files(artifacts.sample_files(store.read_version(spark, "samples", version), books), store.root)
    return store.read_version(spark, "samples", version)


def commit(
    spark: SparkSession, store: Store, reviewed: DataFrame, settings: Settings = Settings(), filed: bool = False
) -> DataFrame:
    """Merge approved words into the lexicon and void the audio of chapters that use them.

    ``reviewed`` has (book_id, ord, word, ipa, approved); ``ord`` is the order in
    the review list.  With ``filed`` the lexicon file is written too.  Returns the affected chapters.
    """
    version = store.new_version(spark)
    chosen = lexicon.approved(reviewed)
    merged = lexicon.upsert_lexicon(lexicon_of(spark, store, settings), chosen)
    store.write(merged, "lexicon", version)
    if filed:
        artifacts.write_lexicon_json(store.read_version(spark, "lexicon", version), rooted(settings.paths_lexicon))
    hit = lexicon.affected_by_index(
        store.read(spark, "postings"), chosen.select("book_id", "word"), book=["book_id"]
    )
    store.write(hit.withColumn("run", F.lit(version).cast("bigint")), "invalidated", version)
    return store.read_version(spark, "invalidated", version).select("book_id", "index")
