"""Registry of named queries over the given tables.

``documents`` stands in for chapters (book = source, index = doc_id), ``pages``
for spine documents, words of ``benchmark`` for the dictionary and the lexicon,
``conversations`` and ``labels`` for reviewer input.  The tables hold few of the
characters the clean-up rules act on, so some queries first put them in with
plain replacements that the checking SQL repeats.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import audio, encoding, packing, segment, text, words
from quillspark.functions.columns import explode_with_pos, is_blank, strip
from quillspark.functions.html import parse_html
from quillspark.operators import chapters as ch
from quillspark.operators import incremental, lexicon, morphology, postings, synth, timeline, vocab
from quillspark.operators.scale import materialize, narrow_index, shared_dir, spread
from quillspark.plans.prepare import book_meta as prepare_meta
from quillspark.sources import artifacts, book_source, tables, testbooks

RARE_ZIPF = 4.0  # the small corpus has no word below the default threshold
FRAMES_PER_CHAR, RATE = 8, 8_000
PART_BYTES = 16_000
WAV_HEADER = 44
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- inputs ---------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *(columns or ("text",))))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-cased words of the benchmark texts."""
    found = table(spark, sf_dir, "benchmark").select(
        F.explode(words.runs(F.lower("text"))).alias("word")
    )
    return found.distinct()


def made_up_ipa(word: str) -> Column:
    return F.concat(F.lit("\u02c8"), F.reverse(word))


def lexicon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_words(spark, sf_dir).select("word", made_up_ipa("word").alias("ipa"))


def chunk_rows_of(spark: SparkSession, sf_dir: str, budget: int = 500) -> DataFrame:
    docs = documents(spark, sf_dir, "text", "source")
    packed = docs.select(
        F.col("source").alias("book_id"),
        F.col("doc_id").alias("index"),
        packing.chunks("text", budget).alias("chunks"),
    )
    return explode_with_pos(packed, F.col("chunks"), "n", "chunk").drop("chunks")


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("index"), "text"
    )
    return vocab.tokens(spread(narrow_index(docs, "index")))


def put_in(column: str, pairs: list[tuple[str, str]]) -> Column:
    out = F.col(column)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


TYPOGRAPHY = [
    (" the ", " \u2014 "), (" of ", " Mr. "), (" and ", " St. "), (" de ", "\u2026 "),
    (" to ", " etc. \u201cand\u201d "), (" la ", " \t e.g.  "), (" in ", " 10\u201320 "),
    (" und ", " it\u2019s Dr. "), (" el ", " vs. \u2018Prof.\u2019 Mrs. Ms. Rev. i.e. "),
    ("\n", "\n \n\n\n\n "),
]
DAMAGE = [
    (" the ", " \x1b[31mthe\x1b[0m "), (" of ", " o\ufb00 \ufb01\ufb02 \ufb03\ufb04\ufb06 "),
    (" and ", " \uff21\uff42\uff01 "), ("\n", "\r\n"), (" to ", "\u2028"), (" in ", " \x07\ufeff "),
    (" la ", " \u201ela\u201f "), (" de ", " \u02bcde\u201b "),
]
MOJIBAKE = [
    ("\u00e9", "\u00c3\u00a9"), ("\u00e8", "\u00c3\u00a8"), ("\u00e4", "\u00c3\u0192\u00c2\u00a4"),
    ("\u00fc", "\u00c3\u00bc"), ("\u00f3", "o\u0301"), (" the ", " the\u00e2\u20ac\u2122s "),
    (" of ", " &quot;of&#34; "), (" and ", " &amp; "), (" to ", " \u00e2\u20ac\u0153to\u00e2\u20ac\u009d "),
    (" de ", " \u00e2\u201a\u00ac5 "), (" und ", " \u00d0\u00b4\u00d0\u00b0 "),
]
NOTE_MARKS = '<a epub:type="Noteref noteref" href="#n">7</a><sup>8 <a href="#m">9</a></sup>'
SKIPPED_SECTION = '<section epub:type="Part TOC"><section epub:type="bodymatter">'
OTHER_SECTION = '<section epub:type="bodymatter chapter"><section epub:type="toc">'
HEADING_LEVELS = [("<h1>", "<h4>Under</h4><h2>"), ("</h1>", "</h2><h3>Side</h3>")]
URL_HINTS = [("blog.", "cover."), ("www.", "endnotes."), ("/fr/", "/plot/"), (".html", "-afterword")]


# -- segmentation and packing ----------------------------------------------


@query
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = documents(spark, sf_dir).select("doc_id", packing.chunks("text").alias("chunks"))
    return timeline.chunk_report(packed, ["doc_id"])


@query
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows_of(spark, sf_dir).select(F.col("index").alias("doc_id"), "n", "chunk")


@query
def chunk_rows_b100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows_of(spark, sf_dir, 100).select(F.col("index").alias("doc_id"), "n", "chunk")


@query
def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", segment.sentences("text").alias("_s"))
    return explode_with_pos(docs, F.col("_s"), "pos", "sentence").drop("_s")


@query
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", segment.sentences("text").alias("_s"))
    return docs.select("doc_id", F.size("_s").cast("bigint").alias("n_sentences"))


@query
def longest_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = segment.longest_clause("text").cast("bigint").alias("longest")
    return documents(spark, sf_dir).select("doc_id", longest)


@query
def hard_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as if it were one over-long sentence."""
    line = strip(F.regexp_replace("text", "\\s+", " "))
    docs = documents(spark, sf_dir).select("doc_id", packing.hard_split(line, 200).alias("_p"))
    return explode_with_pos(docs, F.col("_p"), "n", "piece").drop("_p")


@query
def terminated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", segment.terminated_sentences("text").alias("_s")
    )
    return explode_with_pos(docs, F.col("_s"), "pos", "sentence").drop("_s")


@query
def paired_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences paired with chunk lengths by position, cut to the shorter list."""
    docs = documents(spark, sf_dir).select(
        "doc_id",
        segment.sentences("text").alias("titles"),
        F.transform(packing.chunks("text", 100), lambda c: F.length(c)).alias("lengths"),
    )
    pairs = docs.select(
        "doc_id", F.explode_outer(timeline.pair_by_position("titles", "lengths")).alias("p")
    ).filter(F.col("p").isNotNull())
    return pairs.select(
        "doc_id", F.col("p.pos").cast("bigint").alias("pos"), F.col("p.left").alias("title"),
        F.col("p.right").cast("bigint").alias("chars"),
    )


# -- clean-up and naming -----------------------------------------------------


@query
def normalize_typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", put_in("text", TYPOGRAPHY).alias("text"))
    return docs.select("doc_id", text.normalize("text").alias("text"))


@query
def repair_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", put_in("text", DAMAGE).alias("text"))
    return docs.select("doc_id", text.repair("text").alias("text"))


@query
def repair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with letters decoded wrongly once and twice, references and loose accents put in; and as they are."""
    return documents(spark, sf_dir).select(
        "doc_id", encoding.repair_all(put_in("text", MOJIBAKE)).alias("text"), encoding.repair_all("text").alias("clean")
    )


@query
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", text.slug(title).alias("slug"), text.slug(F.regexp_replace(title, "[A-Za-z]", "?"))
        .alias("bare_slug"),
    )


@query
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows_of(spark, sf_dir).select(
        F.col("index").alias("doc_id"), "n",
        F.concat_ws(
            "/", "book_id", audio.chapter_key("index"),
            F.concat(audio.chunk_key("n"), F.lit(".wav")),
        ).alias("path"),
        text.prefix("chunk", 60).alias("shown"),
    )


@query
def service_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = put_in("url", [("/en/", "/v1/"), ("/de/", "/v1/audio/v1/")])
    return table(spark, sf_dir, "pages").select(
        "page_id", audio.service_base(url).alias("base"), text.basename("url").alias("file")
    )


@query
def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: status and attempt derived from the event."""
    status = F.pmod("event_id", F.lit(500)) + 100
    return table(spark, sf_dir, "events").select(
        "event_id",
        audio.is_reachable(status).alias("reachable"),
        audio.backoff_seconds(F.pmod("user_id", F.lit(3))).alias("wait"),
    )


# -- pages to chapters ---------------------------------------------------------


@query
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = pages(spark, sf_dir).select("page_id", parse_html("html").alias("page"))
    rows = explode_with_pos(parsed, F.col("page.blocks"), "pos", "block")
    return rows.select("page_id", "pos", "block.tag", "block.text")


@query
def html_leaf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = pages(spark, sf_dir).select("page_id", parse_html("html", "leaf").alias("page"))
    rows = explode_with_pos(parsed, F.col("page.blocks"), "pos", "block")
    return rows.select("page_id", "pos", "block.tag", "block.text")


@query
def html_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ch.extract_html(pages(spark, sf_dir).withColumnRenamed("url", "name"))
    return found.select("page_id", "kind", "title", "text")


@query
def marked_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with note markers, section types and headings of several levels put in."""
    levels = put_in("html", HEADING_LEVELS)
    marked = F.replace(levels, F.lit("</p>"), F.lit(NOTE_MARKS + "</p>"))
    section = F.when(F.contains("url", F.lit("/en/")), SKIPPED_SECTION).otherwise(OTHER_SECTION)
    put = F.replace(marked, F.lit("<body>"), F.concat(F.lit("<body>"), section))
    found = ch.extract_html(pages(spark, sf_dir).select("page_id", F.col("url").alias("name"), put.alias("html")))
    return found.select("page_id", "kind", "title", "text")


@query
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.substring_index(F.substring_index("url", "?", 1), "/", -2)
    types = F.replace(section, F.lit("es/"), F.lit("Bodymatter TOC "))
    return table(spark, sf_dir, "pages").select(
        "page_id", ch.classify(put_in("url", URL_HINTS), types).alias("kind")
    )


@query
def chapter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body chapters with gaps where front matter, back matter or blank pages sit."""
    blanked = F.when(
        F.contains("url", F.lit("#top")), F.regexp_replace("html", "<(h1|p|li)>", "<i>")
    ).otherwise(F.col("html"))
    spine = pages(spark, sf_dir).select(
        F.regexp_extract("url", "//([^/]*)/", 1).alias("book_id"),
        F.col("page_id").alias("pos"), put_in("url", URL_HINTS).alias("name"),
        blanked.alias("html"),
    )
    extracted = materialize(ch.extract_html(spine), "chapters")
    numbered = ch.body(ch.number_chapters(extracted, width=64))
    return numbered.select("book_id", "pos", "index", "title")


def containers_of(spark: SparkSession, sf_dir: str) -> str:
    """A folder of container files bound from the pages."""
    root = f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}"
    bound = testbooks.pages_to_containers(pages(spark, sf_dir))
    artifacts.write_files(artifacts.plain_files(bound.select(text.basename("path").alias("name"), "content"), "inbox"), root)
    return f"{root}/inbox"


@query
def container_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of container files in reading order; each file is read by several tasks."""
    docs = book_source.read_documents(spark, containers_of(spark, sf_dir), span="32768")
    return docs.select(
        F.regexp_extract("book_id", "vol([0-9]+)", 1).cast("bigint").alias("volume"), "pos",
        "item_id", "name", "html",
    )


@query
def container_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = book_source.read_books(spark, containers_of(spark, sf_dir))
    return books.select("title", "author", "slug", "source")


@query
def extract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ch.extract_html(
        pages(spark, sf_dir).select("page_id", put_in("url", URL_HINTS).alias("name"), "html")
    ).filter(~is_blank("text"))
    return found.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.min(text.prefix("title", 46)).alias("first_title"),
    )


# -- vocabulary ------------------------------------------------------------------


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.token_counts(documents(spark, sf_dir))


@query
def majority_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = vocab.spelling_stats(tokens_of(spark, sf_dir), ["book_id"])
    return vocab.word_stats(stats, ["book_id"]).select("book_id", "low", "count", "word")


@query
def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = vocab.spelling_stats(tokens_of(spark, sf_dir), ["book_id"])
    named = vocab.word_stats(stats, ["book_id"]).filter(F.col("label").isNotNull())
    return named.select("book_id", "low", "label")


@query
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct spellings that the dictionary does not hold; its entries are capitalised."""
    dictionary = benchmark_words(spark, sf_dir).select(F.initcap("word").alias("word"))
    found = documents(spark, sf_dir).select(F.explode_outer(words.runs("text")).alias("word"))
    candidates = found.filter(words.is_candidate_shape("word")).distinct()
    return vocab.drop_known(candidates, "word", dictionary)


@query
def regular_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the documents that may be regular forms of a dictionary word, by the tag that makes them one."""
    found = documents(spark, sf_dir).select(F.explode_outer(words.runs("text")).alias("word"))
    tags = F.array(*map(F.lit, sorted({t for of in morphology.TAGS.values() for t in of})))
    tagged = found.filter(words.is_candidate_shape("word")).distinct().withColumn("tag", F.explode(tags))
    return morphology.regular_forms(tagged, benchmark_words(spark, sf_dir))


@query
def corpus_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipf = vocab.zipf_table(vocab.token_counts(documents(spark, sf_dir)))
    return zipf.select("word", F.bround("zipf", 2).alias("zipf"))


def review_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequency = vocab.zipf_table(vocab.token_counts(documents(spark, sf_dir)))
    return vocab.oov(
        tokens_of(spark, sf_dir), benchmark_words(spark, sf_dir),
        materialize(frequency, "frequency"), rare_zipf=RARE_ZIPF, min_count=2,
    )


@query
def oov_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = review_of(spark, sf_dir).orderBy("book_id", *vocab.review_order())
    return ordered.drop("ipa")


@query
def oov_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.top_candidates(review_of(spark, sf_dir), 30).drop("ipa")


@query
def review_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.review_lines(review_of(spark, sf_dir)).select("book_id", "line")


# -- lexicon ------------------------------------------------------------------------


@query
def lexicon_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.apply_lexicon(
        documents(spark, sf_dir), "text", lexicon_table(spark, sf_dir), ["doc_id"]
    )


@query
def lexicon_apply_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rewrite by the route for a lexicon too large to ship."""
    return lexicon.apply_lexicon(
        documents(spark, sf_dir), "text", lexicon_table(spark, sf_dir), ["doc_id"], ship_rows=0
    )


def benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of neighbouring words of the benchmark texts."""
    spans = table(spark, sf_dir, "benchmark").select(words.runs(F.lower("text")).alias("w"))
    pairs = spans.select(
        F.explode(F.arrays_zip(F.col("w"), F.expr("slice(w, 2, size(w))").alias("v"))).alias("p")
    ).filter(F.col("p.v").isNotNull())
    return pairs.select(F.concat_ws(" ", "p.w", "p.v").alias("word")).distinct()


@query
def lexicon_apply_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and two-word entries together; the longer entry wins where both fit."""
    phrases = benchmark_phrases(spark, sf_dir)
    entries = phrases.select("word", made_up_ipa("word").alias("ipa")).unionByName(
        lexicon_table(spark, sf_dir)
    )
    return lexicon.apply_lexicon(documents(spark, sf_dir), "text", entries, ["doc_id"])


def chunked_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text", "source").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("index"),
        packing.chunks("text").alias("chunks"),
    )


@query
def affected_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = benchmark_words(spark, sf_dir).union(benchmark_phrases(spark, sf_dir))
    return lexicon.affected(chunked_of(spark, sf_dir), entries)


@query
def phrase_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each pair of words occurs, by the positions of its words in the index."""
    key = ["book_id", "index"]
    text = F.array_join("chunks", " ")
    held = postings.occurrences_in(chunked_of(spark, sf_dir), text, benchmark_phrases(spark, sf_dir), key)
    return held.groupBy("word").agg(F.count(F.lit(1)).alias("n_chapters"))


def examples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk_table = chunk_rows_of(spark, sf_dir).drop("book_id")
    return lexicon.example_sentence(chunk_table, benchmark_words(spark, sf_dir), book=[])


@query
def example_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples_of(spark, sf_dir)


@query
def review_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ipa = F.when(F.length("word") > 3, made_up_ipa("word")).otherwise(F.lit(""))
    candidates = examples_of(spark, sf_dir).withColumn("ipa", ipa)
    return lexicon.variants(candidates).select("word", "variant", "input", "sample")


@query
def lexicon_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' words from conversations, in turn order, over the lexicon."""
    turns = _turns(spark, sf_dir)
    return lexicon.upsert_lexicon(lexicon_table(spark, sf_dir), lexicon.approved(turns))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every turn as a reviewed word, in the order of the turns and of the words in them."""
    said = table(spark, sf_dir, "conversations").select("*", words.runs("text").alias("_w"))
    return explode_with_pos(said, F.col("_w"), "_place", "word").select(
        "word",
        F.format_string("%d.%d.%d", "conv_id", "turn", "_place").alias("ipa"),
        ((F.col("conv_id") * 100_000 + F.col("turn")) * 1_000_000 + F.col("_place")).alias("ord"),
        (F.col("role") == "user").alias("approved"),
    )


@query
def lexicon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lexicon_json_lines(lexicon_table(spark, sf_dir)).select("line")


# -- audio and timeline -------------------------------------------------------------


@query
def synthesis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = audio.request_json("chunk", "model-1", "voice-1", 1.0)
    return chunk_rows_of(spark, sf_dir).select(
        F.col("index").alias("doc_id"), "n", body.alias("body")
    )


def rendered_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk audio whose samples are the bytes of the text."""
    return synth.synthesize(chunk_rows_of(spark, sf_dir), synth.ByteSynthesizer(RATE), "chunk")


def durations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and rate as the WAV of each chunk has them."""
    return timeline.chunk_durations(rendered_of(spark, sf_dir)).drop("pcm")


@query
def chapter_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.chapter_seconds(durations_of(spark, sf_dir))


@query
def chapter_wavs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter audio of 8 frames for each character, the code points of the chunks over and over, and its digest."""
    backend = synth.CodeSynthesizer(RATE, FRAMES_PER_CHAR // 2)
    spoken = synth.synthesize(chunk_rows_of(spark, sf_dir), backend, "chunk")
    parts = timeline.chapter_audio(spoken, part_bytes=PART_BYTES)
    return parts.select(
        "book_id", "index", "part", "frames", "rate", F.octet_length("wav").cast("bigint").alias("wav_bytes"),
        F.md5(F.expr(f"substring(wav, {WAV_HEADER + 1})")).alias("samples"),
    )


@query
def render_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = timeline.chapter_seconds(durations_of(spark, sf_dir)).withColumn(
        "title", F.format_string("Chapter %d of the collected documents", "index")
    )
    return timeline.render_report(titled)


@query
def book_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.book_hours(timeline.chapter_seconds(durations_of(spark, sf_dir)))


def marks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = table(spark, sf_dir, "documents").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("index"),
        F.col("text").alias("title"), (F.col("n_chars") / 16).alias("seconds"),
    )
    return timeline.marks(timed, width=1_000)


def books_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("book_id")).agg(
        F.concat(F.lit("T=1; #"), F.first("source")).alias("title"),
        F.concat(F.lit("A\\B "), F.min("lang")).alias("author"),
    )


@query
def chapter_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks_of(spark, sf_dir)


@query
def metadata_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.ffmetadata(marks_of(spark, sf_dir), books_of(spark, sf_dir))


@query
def concat_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("index")
    )
    folder = F.concat(F.lit("/work/o'"), F.col("book_id"), F.lit("/audio"))
    return timeline.concat_manifest(docs, folder)


def _digests(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """The files of ``pieces`` written and read back."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    artifacts.write_files(pieces, root)
    return artifacts.file_digests(spark, root)


@query
def render_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concat.txt and ffmetadata.txt of each source's documents, written as files and read back."""
    books = books_of(spark, sf_dir).withColumn("slug", F.col("book_id"))
    blocks = timeline.ffmetadata(marks_of(spark, sf_dir), books_of(spark, sf_dir))
    lines = concat_manifest(spark, sf_dir).withColumn("part", F.lit(0))
    return _digests(spark, artifacts.timeline_files(blocks, lines, books))


@query
def prepared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chapters.json, review.json, review.md and meta.json of each source's documents, written as files and read back."""
    chunked = documents(spark, sf_dir, "text", "source", "lang").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("index"), F.col("lang").alias("title"),
        packing.chunks("text").alias("chunks"),
    )
    books = books_of(spark, sf_dir).select(
        "*", F.col("book_id").alias("slug"), F.concat(F.lit("sí."), "book_id").alias("source")
    )
    review = materialize(review_of(spark, sf_dir), "review")
    meta = prepare_meta(books, chunked, review)
    return _digests(spark, artifacts.prepared_files(books, chunked, review, meta))


# -- incremental ------------------------------------------------------------------------


@query
def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of good documents count as rendered unless their audio is empty."""
    work = chunk_rows_of(spark, sf_dir)
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(
        F.col("doc_id").alias("index")
    )
    size = F.when(F.contains("chunk", F.lit("!")), 0).otherwise(F.length("chunk"))
    done = work.join(good, "index").withColumn("bytes", size)
    left = incremental.pending(work, done, size="bytes")
    return left.select("book_id", F.col("index").alias("doc_id"), "n")


def _inbox(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    host = F.regexp_extract("url", "//([^/]*)/", 1)
    inbox = table(spark, sf_dir, "pages").select("page_id", "url", text.slug(host).alias("slug"))
    return inbox.drop("url"), inbox.filter(F.startswith("url", F.lit("https:"))).select("slug")


@query
def inbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pending_books(*_inbox(spark, sf_dir)).select("page_id", "slug")


@query
def inbox_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.done_counts(*_inbox(spark, sf_dir))


@query
def live_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log as audio runs; purchases void what a user rendered before them."""
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("book_id"), F.lit(0).alias("index"),
        F.col("event_id").alias("n"), F.col("event_id").alias("run"), "event_type",
    )
    void = log.filter("event_type = 'purchase'").select("book_id", "index", "run")
    live = incremental.live_audio(log.filter("event_type <> 'purchase'"), void)
    return live.select(F.col("book_id").alias("user_id"), F.col("n").alias("event_id"))


@query
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", incremental.content_key("text", "voice-1", 1.0).alias("key")
    )


# -- whole books ---------------------------------------------------------------------------


@query
def book_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "text", "source").select(
        F.col("source").alias("book_id"), F.size(packing.chunks("text")).alias("n")
    )
    counted = docs.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_chapters"), F.sum("n").alias("n_chunks")
    )
    review = review_of(spark, sf_dir).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_review_candidates")
    )
    return counted.join(review, "book_id", "left").fillna(0, ["n_review_candidates"])


@query
def chapters_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked chapters written as JSON per book and read back."""
    docs = documents(spark, sf_dir, "text", "source").select(
        F.col("source").alias("book_id"), F.col("doc_id").cast("int").alias("index"),
        F.col("text").alias("title"), packing.chunks("text").alias("chunks"),
    )
    back = tables.round_trip_chapters(docs)
    rows = explode_with_pos(back, F.col("chunks"), "n", "chunk")
    return rows.select("book_id", "index", "title", "n", "chunk")


@query
def inbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books bound from pages arrive in a folder and are processed once."""
    from quillspark.plans.inbox import stream_pages

    return stream_pages(spark, pages(spark, sf_dir))


@query
def inbox_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every batch processed twice, as after a failure before its commit."""
    from quillspark.plans.inbox import stream_pages

    return stream_pages(spark, pages(spark, sf_dir), repeats=2)
