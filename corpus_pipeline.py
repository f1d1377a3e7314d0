"""A corpus made ready for training: five stages, each a table written and read again.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> mixing -> token files.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm import adapt_join, curriculum, lsi, quality, token_files
from quillspark.llm.tables import END_ID, table, tokenizer_path
from quillspark.operators.scale import materialize, shared_dir, sized_join
from quillspark.session import ship

BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = "1000"  # documents handed to Python at a time; what stays of a batch's memory adds up over stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _ready(spark: SparkSession) -> None:
    """Send the package to the executors and keep batches small.

    A stage's result is planned when its caller writes it, so a stage called by itself leaves the setting; ``run`` restores it.
    """
    ship(spark)
    spark.conf.set(BATCH_SETTING, ARROW_ROWS)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Small batches while a pipeline runs; the session's own setting afterwards."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, ARROW_ROWS)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as good; learned from all labels but those of the held-out fold.

    The scores come from whole texts.  Empty texts are scored by their statistics like any other.
    """
    _ready(spark)
    forest = quality.train(docs, table(spark, sf_dir, "labels").filter(quality.fold(F.col("doc_id"), 4) != 2))
    scored = quality.score(docs, forest, "_score")
    return scored.filter(F.col("_score") >= quality.THRESHOLD).drop("_score")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; texts without words all stay.

    Of rows with one id and alike texts one stays, the one whose columns hash lowest.  A group whose ids are all
    null keeps one row too.
    """
    _ready(spark)
    known, rooted = adapt_join.join(docs)
    placed = known.filter("key is not null").join(rooted, "key", "left")
    # Rows alone in their component keep their place; only groups are looked at.
    placed = materialize(placed.select("doc_id", "key", F.coalesce("root", "key").alias("root")), "kept-groups")
    groups = placed.groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    grouped = materialize(placed.join(groups, "root"), "grouped")
    gone = grouped.filter(F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least"))))
    # An id may come with several texts, so rows are known by id and set.
    gone = gone.select(F.coalesce(F.hash("doc_id", "key"), F.lit(0)).alias("_h"), F.xxhash64("doc_id", "key").alias("_k")).distinct()
    unclear = grouped.filter(F.col("least").isNull() | (F.col("doc_id") == F.col("least")))
    unclear = unclear.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    keyed = adapt_join.with_key(docs, "_key")
    keyed = keyed.withColumn("_h", F.coalesce(F.hash("doc_id", "_key"), F.lit(0))).withColumn("_k", F.xxhash64("doc_id", "_key"))
    kept = sized_join(keyed, materialize(gone, "gone"), ["_h", "_k"], "left_anti")
    if unclear.limit(1).count():
        roots = materialize(placed.select("key", "root").distinct().join(unclear.select("root"), "root"), "unclear")
        many = sized_join(kept, roots.withColumnRenamed("key", "_key"), ["_key"], "left")
        order = W.partitionBy(F.coalesce(F.col("root"), F.xxhash64("_h", "_k", "text"))).orderBy(F.xxhash64(*docs.columns))
        kept = many.withColumn("_n", F.row_number().over(order)).filter(F.col("root").isNull() | (F.col("_n") == 1))
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _ready(spark)
    found = lsi.find_items(docs, table(spark, sf_dir, "benchmark"), "_hits")
    return found.filter(F.size("_hits") == 0).drop("_hits")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    _ready(spark)
    return curriculum.mix(docs)


PLACE = ("_part", "_file", "_row")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its rows' places: of files, their numbers and names in order and the row in each; else the place in the plan."""
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        # Names are padded to five digits only, so they are ordered by their numbers first.
        part = F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
        return docs.select("*", *[c.alias(n) for c, n in zip((part, name, row), PLACE)])
    except AnalysisException:  # not read from files
        return docs.select("*", *[c.alias(n) for c, n in zip((F.lit(0), F.lit(""), F.monotonically_increasing_id()), PLACE)])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows in the order they come, described as read back; a document taken twice is there twice."""
    _ready(spark)
    return token_files.token_files(spark, _numbered(docs), tokenizer_path(), END_ID, PLACE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

# The stages learn models and follow links, which SQL can't express; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    base = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    with _small_batches(spark):
        for name, stage in STAGES:
            path = os.path.join(base, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
