"""Spark-native analytics for long-form text: sections, chunks, vocabulary, lexicon, timelines."""

__version__ = "0.1.0"
