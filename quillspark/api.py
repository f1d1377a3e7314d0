"""The public functions in one place."""

from pyspark.sql import DataFrame

from quillspark.functions.html import parse_html
from quillspark.functions.packing import chunks, hard_split
from quillspark.functions.segment import clauses, sentences, terminated_sentences
from quillspark.functions.text import basename, normalize, repair, slug
from quillspark.operators.chapters import body, classify, extract_html, number_chapters
from quillspark.operators.incremental import content_key, live_audio, pending, pending_books
from quillspark.operators.lexicon import (
    affected, apply_lexicon, approved, example_sentence, proposed, upsert_lexicon, variants,
)
from quillspark.operators.scale import materialize, running_total, sized_join
from quillspark.operators.synth import HttpSynthesizer, SilentSynthesizer, service_status, synthesize
from quillspark.operators.timeline import (
    book_hours, chapter_audio, chapter_seconds, chunk_durations, chunk_report, concat_manifest,
    ffmetadata, marks, pair_by_position, render_report,
)
from quillspark.operators.vocab import oov, review_order, token_counts, tokens, top_candidates, zipf_table
from quillspark.plans.inbox import process_inbox, watch
from quillspark.plans.prepare import book_meta, prepare
from quillspark.plans.render import render
from quillspark.plans.review import commit, samples
from quillspark.sources.epub import books, open_containers, read_containers, spine_docs


def chapters(spine: DataFrame, book: str = "book_id", pos: str = "pos") -> DataFrame:
    """Spine documents (book, pos, name, html) to numbered chapters of all kinds."""
    return number_chapters(materialize(extract_html(spine), "chapters"), book, pos)


__all__ = [name for name in dir() if not name.startswith("_") and name != "DataFrame"]
