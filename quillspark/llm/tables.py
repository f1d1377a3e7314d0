"""Where the queries' inputs are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

END_ID = 2  # closes every encoded document


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file; it is installed on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
