import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import audio, encoding, packing, words
from quillspark.functions.columns import SLICE_CHARS, in_slices
from quillspark.operators import incremental, lexicon, scale, synth, timeline, vocab
from quillspark.session import ship
from quillspark.sources.media import encoder_arguments
from quillspark.sources import artifacts, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- balance helpers ---------------------------------------------------------


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_running_total_equals_plain_sum(spark, width):
    rng = random.Random(1)
    data = [("hot", p, rng.randint(0, 9)) for p in rng.sample(range(60), 40)]
    data += [("small", 5, 2), ("small", 6, 3)]
    df = spark.createDataFrame(data, "g string, p bigint, v bigint")
    want, sums = [], {}
    for g, p, v in sorted(data):
        want.append((g, p, v, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + v
    got = scale.running_total(df, ["g"], "p", "v", "t", width)
    assert rows(got.select("g", "p", "v", "t")) == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_sized_join_salted_equals_broadcast(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 1), ("y", 2)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("x", 3), ("z", 4)], "k string, r int")
    small = scale.sized_join(left, right, ["k"], how)
    salted = scale.sized_join(left, right, ["k"], how, salts=4, max_rows=0)
    assert small.columns == salted.columns
    assert sorted(map(str, small.collect())) == sorted(map(str, salted.collect()))
    assert "_salt" in salted._jdf.queryExecution().toString()


def test_ordinal_orders_like_the_pair(spark):
    pairs = [(0, 5), (1, 0), (0, 2**31 - 1), (2**31 - 1, 3)]
    for kind in ("int", "bigint"):
        df = spark.createDataFrame(pairs, f"i {kind}, p int")
        got = [tuple(r) for r in df.orderBy(scale.ordinal(df, "i", "p")).collect()]
        assert got == sorted(pairs)


def test_narrow_index(spark):
    assert dict(scale.narrow_index(spark.range(5), "id").dtypes)["id"] == "int"
    assert dict(scale.narrow_index(spark.range(2**31, 2**31 + 1), "id").dtypes)["id"] == "bigint"


class _Session:
    """Just the settings of a session."""

    def __init__(self, master, named=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = type("Context", (), {"master": master})()


def test_shared_dir():
    assert scale.shared_dir(_Session("yarn", "hdfs:///ck")) == "hdfs:///ck"
    local = _Session("local[2]")
    assert scale.shared_dir(local) == scale.shared_dir(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scale.shared_dir(_Session("yarn"))


def test_materialize(spark):
    assert scale.materialize(spark.range(3), "x").count() == 3


# -- vocabulary -----------------------------------------------------------------


def tokens(spark, *items):
    return spark.createDataFrame(
        [("b", 0, i, t, None, e) for i, (t, e) in enumerate(items)],
        "book_id string, index int, pos int, text string, tag string, ent_type string",
    )


def tables_for(spark, known=(), zipf=()):
    return (
        spark.createDataFrame([(w,) for w in known], "word string"),
        spark.createDataFrame(list(zipf), "word string, zipf double"),
    )


def test_majority_spelling_tie_goes_to_first_seen(spark):
    df = tokens(spark, *[(w, None) for w in ("Eloi", "eloi", "eloi", "Eloi")])
    got = vocab.oov(df, *tables_for(spark)).collect()
    assert [(r.word, r["count"], r.label) for r in got] == [("Eloi", 4, "rare")]


def test_gates_and_labels(spark):
    df = tokens(
        spark, ("MIX", None), ("Mix", None), ("a", None), ("x1y", None), ("Weena", "DATE"),
        ("Weena", "GPE"), ("weena", "PERSON"), ("Known", None), ("edge", None), ("below", None),
        ("nameless", "CARDINAL"),
    )
    dictionary, zipf = tables_for(
        spark, ["known"], [("edge", 2.5), ("below", 2.49), ("weena", 6.0), ("nameless", 5.0), ("mix", 1.0)]
    )
    got = {r.word: (r["count"], r.label, r.zipf) for r in vocab.oov(df, dictionary, zipf).collect()}
    assert got == {
        "Mix": (1, "rare", 1.0), "Weena": (3, "GPE", 6.0), "below": (1, "rare", 2.49),
    }


def test_known_under_any_spelling_and_by_tag(spark):
    df = tokens(spark, ("PARIS", None), ("nasa", None), ("opened", None)).withColumn(
        "tag", F.when(F.col("text") == "opened", "VBD")
    )
    dictionary, zipf = tables_for(spark, ["Paris", "NASA"])
    left = vocab.oov(df, dictionary, zipf)
    assert [r.word for r in left.collect()] == ["opened"]
    by_tag = vocab.oov(df, dictionary, zipf, is_known=lambda w, t: t == "VBD")
    assert by_tag.count() == 0


def test_drop_known_salted_route(spark, monkeypatch):
    df = spark.createDataFrame([(w,) for w in ("Eloi", "PARIS", "the")], "word string")
    dictionary = spark.createDataFrame([("Paris",), ("The",)], "word string")
    monkeypatch.setattr(vocab, "fits_broadcast", lambda *a: False)
    assert [r.word for r in vocab.drop_known(df, "word", dictionary).collect()] == ["Eloi"]


def test_review_order_and_top(spark):
    df = spark.createDataFrame(
        [("b", "r", 9, "rare", 0.0), ("b", "p2", 2, "PERSON", 0.0), ("b", "p5", 5, "PERSON", 3.0),
         ("b", "P5", 5, "PERSON", 1.0)],
        "book_id string, word string, count bigint, label string, zipf double",
    )
    assert [r.word for r in df.orderBy(*vocab.review_order()).collect()] == ["P5", "p5", "p2", "r"]
    top = vocab.top_candidates(df, 2)
    assert [(r.word, r["rank"]) for r in top.orderBy("rank").collect()] == [("P5", 1), ("p5", 2)]


def test_heuristic_tokens(spark):
    df = spark.createDataFrame(
        [("b", 0, '"Weena ran. Then Weena\'s friend, Élan, left."')],
        "book_id string, index int, text string",
    )
    got = [(r.text, r.ent_type) for r in vocab.tokens(df).orderBy("pos").collect()]
    assert got == [
        ("Weena", None), ("ran", None), ("Then", None), ("Weena", "PERSON"), ("friend", None),
        ("Élan", "PERSON"), ("left", None),
    ]


# -- lexicon --------------------------------------------------------------------------


def by_regex(text, entries):
    """The rewrite as one alternation, longest entry first."""
    choice = "|".join(map(re.escape, sorted(entries, key=len, reverse=True)))
    return re.sub(
        rf"\b({choice})\b", lambda m: f"[{m.group(0)}](/{entries[m.group(0).lower()]}/)", text,
        flags=re.I,
    )


@pytest.mark.parametrize("ship_rows", [lexicon.SHIP_ROWS, 0])
def test_apply_lexicon(spark, ship_rows):
    ship(spark)
    entries = {
        "eloi": "X", "time": "A", "time traveller": "B", "o'brien": "C", "jean-luc": "D", "e.g.": "E",
        "'tis": "F", "élan": "G", "a": "H", "a b": "I", "b": "J", "-b": "K", "x_1": "L",
    }
    rng = random.Random(3)
    pieces = [*entries, "ELOI", "Time", "eloin", " ", " ", " ", "'s", "-", ".", "\n", "É", "1", "_", "’"]
    texts = ["Eloi and ELOI's eloin", "Time Traveller's time", ""]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    lex = spark.createDataFrame(list(entries.items()), "word string, ipa string")
    got = lexicon.apply_lexicon(df, "t", lex, ["id"], out="r", ship_rows=ship_rows)
    for r in got.collect():
        assert r.r == by_regex(r.t, entries), r.t


def test_apply_lexicon_edges(spark):
    df = spark.createDataFrame([(1, "[Eloi](/X/) Eloi")], "id int, t string")
    none = spark.createDataFrame([], "word string, ipa string")
    assert lexicon.apply_lexicon(df, "t", none, ["id"]).first().t == "[Eloi](/X/) Eloi"
    upper = spark.createDataFrame([("ELOI", "Y")], "word string, ipa string")
    assert (
        lexicon.apply_lexicon(df, "t", upper, ["id"]).first().t
        == "[[Eloi](/Y/)](/X/) [Eloi](/Y/)"
    )
    kept = lexicon.apply_lexicon(df, "t", upper, ["id"], keep_marked=True)
    assert kept.first().t == "[Eloi](/X/) [Eloi](/Y/)"


def test_phrase_query_equals_regex_on_documents(spark, sf_dir):
    from quillspark.plans import catalog

    entries = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        runs = re.findall(r"\w+", r.text.lower())
        for phrase in map(" ".join, zip(runs, runs[1:])):
            entries[phrase] = "ˈ" + phrase[::-1]
        for run in runs:
            entries[run] = "ˈ" + run[::-1]
    by_first = {}
    for word in entries:
        by_first.setdefault(word.split(" ")[0], []).append(word)
    got = {r.doc_id: r.text for r in catalog.QUERIES["lexicon_apply_phrases"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        present = {w for run in set(re.findall(r"\w+", r.text.lower())) for w in by_first.get(run, ())}
        low = r.text.lower()
        present = {w: entries[w] for w in present if w in low}
        assert got[r.doc_id] == (by_regex(r.text, present) if present else r.text)


def test_upsert_last_wins(spark):
    lex = spark.createDataFrame([("Eloi", "old"), ("weena", "w")], "word string, ipa string")
    new = spark.createDataFrame([("eloi", "b", 2), ("Eloi", "a", 1)], "word string, ipa string, ord int")
    assert rows(lexicon.upsert_lexicon(lex, new)) == [("eloi", "b"), ("weena", "w")]


def test_affected_words_and_phrases(spark):
    chapters = spark.createDataFrame(
        [("b", 0, ["The ÉLOI came.", "So did the Time"]), ("b", 1, ["Traveller alone", "éloin"]),
         ("b", 2, ["a Time", "Traveller's x"]), ("c", 0, ["éloi"])],
        "book_id string, index int, chunks array<string>",
    )
    one = spark.createDataFrame([("b", "Éloi")], "book_id string, word string")
    assert rows(lexicon.affected(chapters, one, book=["book_id"])) == [("b", 0)]
    both = spark.createDataFrame([("time traveller",), ("éloi",)], "word string")
    assert rows(lexicon.affected(chapters, both)) == [("b", 0), ("b", 2), ("c", 0)]


def test_example_sentence(spark):
    chunks = spark.createDataFrame(
        [("b", 0, 0, "Eloi ran"), ("b", 1, 0, "Foo bar. The Eloi ran! end"), ("b", 1, 1, "Eloi again."),
         ("b", 2, 0, "x" * 300 + " weena. A weena here."), ("c", 0, 0, "The Time Traveller spoke.")],
        "book_id string, index int, n int, chunk string",
    )
    wanted = spark.createDataFrame(
        [("b", "eloi"), ("b", "weena"), ("b", "gone"), ("c", "time traveller"), ("c", "eloi")],
        "book_id string, word string",
    )
    assert rows(lexicon.example_sentence(chunks, wanted)) == [
        ("b", "eloi", "The Eloi ran!"), ("b", "gone", "The name is gone."),
        ("b", "weena", "A weena here."), ("c", "eloi", "The name is eloi."),
        ("c", "time traveller", "The Time Traveller spoke."),
    ]


def test_variants(spark):
    df = spark.createDataFrame(
        [("Eloi", "The ELOI, eloin.", "$1\\x"), ("b", "b", None), ("c", "c", "")],
        "word string, sentence string, ipa string",
    )
    got = {r.variant: (r.input, r.sample) for r in lexicon.variants(df).collect()}
    assert got == {
        "default": ("The ELOI, eloin.", "Eloi__default.wav"),
        "proposed": ("The [ELOI](/$1\\x/), eloin.", "Eloi__proposed.wav"),
    }


def test_whole_word_pattern_with_odd_edges(spark):
    df = spark.createDataFrame(
        [("say e.g.x", "e.g."), ("say e.g. x", "e.g."), ("a\\Eb", "a\\Eb"), ("É", "é")],
        "t string, w string",
    )
    assert [r[0] for r in df.select(words.contains_word("t", "w")).collect()] == [True, False, True, True]


def test_lexicon_json(spark, tmp_path):
    path = tmp_path / "custom.json"
    path.write_text('{"Eloi": "\\u02c8X", "weena": "w"}')
    assert rows(tables.read_lexicon_json(spark, str(path))) == [("eloi", "ˈX"), ("weena", "w")]
    assert tables.read_lexicon_json(spark, str(tmp_path / "none.json")).count() == 0


def test_lexicon_json_is_one_sorted_map(spark, tmp_path):
    lex = spark.createDataFrame([("weena", 'a"b'), ("eloi", "\u02c8X"), ("el", "c")], "word string, ipa string")
    path = tmp_path / "lexicon" / "custom.json"
    ship(spark)
    artifacts.write_lexicon_json(lex, str(path))
    assert path.read_text() == '{\n  "el": "c",\n  "eloi": "\u02c8X",\n  "weena": "a\\"b"\n}'
    assert [p.name for p in path.parent.iterdir()] == ["custom.json"]
    artifacts.write_lexicon_json(lex.filter("word > 'f'"), str(path))  # replaces the file
    assert json.loads(path.read_text()) == {"weena": 'a"b'}
    artifacts.write_lexicon_json(lex.filter("false"), str(path))
    assert json.loads(path.read_text()) == {}


# -- audio and timeline -------------------------------------------------------------------


def test_marks_round_before_summing(spark):
    df = spark.createDataFrame(
        [("b", 0, "I", 3.0), ("b", 1, "II", 2.0), ("b", 3, "III", 0.0005), ("b", 7, "IV", 0.0015)],
        "book_id string, index int, title string, seconds double",
    )
    got = timeline.marks(df, width=2).orderBy("index").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 3000), (3000, 5000), (5000, 5000), (5000, 5002)]


def test_metadata_text(spark):
    marks = spark.createDataFrame(
        [("b", 0, "a=b;c#d\\e", 0, 5)], "book_id string, index int, title string, start_ms bigint, end_ms bigint"
    )
    books = spark.createDataFrame([("b", "T", "A\nB")], "book_id string, title string, author string")
    got = [r.block for r in timeline.ffmetadata(marks, books).orderBy("seq").collect()]
    assert got == [
        ";FFMETADATA1\ntitle=T\nartist=A\\\nB\nalbum=T\ngenre=Audiobook",
        "[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=5\ntitle=a\\=b\\;c\\#d\\\\e",
    ]


@pytest.mark.parametrize("part_bytes, parts", [(timeline.PART_BYTES, 1), (60_000, 2)])
def test_chapter_audio_joins_in_order(spark, part_bytes, parts):
    ship(spark)
    pcm = [bytes([i]) * (int(24_000 * s) * 2) for i, s in enumerate((0.5, 1.0, 1.5))]
    data = [("b", 0, i, audio.make_wav(p)) for i, p in enumerate(pcm)]
    df = spark.createDataFrame(data[::-1], "book_id string, index int, n int, wav binary")
    assert timeline.chapter_seconds(timeline.chunk_durations(df)).first().seconds == 3.0
    joined = timeline.chapter_audio(df, part_bytes=part_bytes).orderBy("part")
    again = joined.select("part", audio.parse_wav("wav").alias("w")).orderBy("part").collect()
    assert len(again) == parts
    assert b"".join(bytes(r.w.pcm) for r in again) == b"".join(pcm)


def test_samples_are_shuffled_once(spark, capsys):
    """One exchange carries samples: of all runs to the task of their chapter, which picks the latest."""
    ship(spark)
    data = [("b", 0, n, r, audio.make_wav(bytes([65 + n, r]) * 3)) for n in range(3) for r in range(n + 1)]
    df = spark.createDataFrame(data, "book_id string, index int, n int, run bigint, wav binary").repartition(4)
    joined = timeline.chapter_audio(df)
    row = joined.select("part", audio.parse_wav("wav").alias("w")).collect()
    assert len(row) == 1 and bytes(row[0].w.pcm) == b"".join(bytes([65 + n, n]) * 3 for n in range(3))
    capsys.readouterr()
    joined.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_long_chapters_are_dealt_over_tasks(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(timeline, "CHUNK_BUCKET", 4)
    data = [("b", 0, n, audio.make_wav(bytes([n]) * 2)) for n in range(10)]
    df = spark.createDataFrame(data, "book_id string, index int, n int, wav binary").repartition(3)
    got = timeline.chapter_audio(df, part_bytes=6).select("part", audio.parse_wav("wav").alias("w")).orderBy("part").collect()
    own = timeline.BUCKET_PARTS
    assert [r.part for r in got] == [0, 1, own, own + 1, 2 * own]
    assert b"".join(bytes(r.w.pcm) for r in got) == b"".join(bytes([n]) * 2 for n in range(10))


def test_pair_by_position(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [1, 2])], "l array<string>, r array<int>")
    got = df.select(timeline.pair_by_position("l", "r").alias("p")).first().p
    assert [tuple(p) for p in got] == [(0, "a", 1), (1, "b", 2)]


def test_names_and_numbers(spark):
    df = spark.range(1).select(
        audio.chapter_key(F.lit(7)), audio.chapter_key(F.lit(1234)), audio.chunk_key(F.lit(12)),
        audio.to_minutes(F.lit(90.0)), audio.to_hours(F.lit(9000.0)),
        audio.service_base(F.lit("http://h:8000/v1/audio/speech")),
        audio.is_reachable(F.lit(404)), audio.is_reachable(F.lit(500)),
        audio.backoff_seconds(F.lit(2)),
    )
    assert tuple(df.first()) == (
        "ch007", "ch1234", "chunk0012", 1.5, 2.5, "http://h:8000", True, False, 4.0,
    )


def test_encoder_arguments(spark):
    df = spark.createDataFrame([("c.txt", "m.txt", "o.m4b", None), ("c.txt", "m.txt", "o.m4b", "p.jpg")],
                               "c string, m string, o string, p string")
    plain, cover = [r[0] for r in df.select(encoder_arguments("c", "m", "o", F.col("p"))).collect()]
    assert plain[:2] == ["ffmpeg", "-y"] and "attached_pic" not in plain and plain[-1] == "o.m4b"
    assert "p.jpg" in cover and "attached_pic" in cover


# -- synthesis and increments ------------------------------------------------------------------


def test_a_pause_follows_every_failure():
    pauses, answers = [], [b"", b"ok"]

    class Slow:
        def render(self, text):
            return answers.pop(0)

    assert synth.speak(Slow(), "t", synth.Patience(3), pauses.append) == (b"ok", None) and pauses == [1]
    pauses.clear()
    sound, trouble = synth.speak(Slow(), "t", synth.Patience(3), pauses.append)
    assert sound is None and trouble.startswith("IndexError") and pauses == [1, 2, 4]


def test_no_answer_no_status():
    assert synth.service_status("http://127.0.0.1:9/v1/audio/speech", timeout=0.2) is None
    assert synth.service_status("no address") is None


def test_audio_leaves_in_frames(spark):
    """A partition may hold more audio than one Arrow column could."""
    docs = spark.range(40).selectExpr("id", "repeat('x', 100) as text").coalesce(1)
    made = synth.synthesize(docs, synth.SilentSynthesizer(8_000, 8), frame_bytes=2_000)
    rows = made.select("id", "bytes", "frames", "rate", "error").collect()
    assert len(rows) == 40 and {(r.bytes, r.frames, r.rate, r.error) for r in rows} == {(1_644, 800, 8_000, None)}


def test_spellings_of_one_key_give_one_entry(spark):
    """Shipped or joined, the last spelling in code-point order counts."""
    entries = spark.createDataFrame([("Eloi", "x"), ("eloi", "y"), ("ELOI", "z")], "word string, ipa string")
    texts = spark.createDataFrame([(1, "Eloi met ELOI")], "id int, text string")
    for most in (100, 0):
        got = lexicon.apply_lexicon(texts, "text", entries, ["id"], ship_rows=most).first().text
        assert got == "[Eloi](/y/) met [ELOI](/y/)"


def test_pending_keeps_empty_results(spark):
    work = spark.createDataFrame([("b", 0, n) for n in range(3)], "book_id string, index int, n int")
    done = spark.createDataFrame([("b", 0, 0, 5), ("b", 0, 1, 0)], "book_id string, index int, n int, bytes int")
    assert rows(incremental.pending(work, done, size="bytes")) == [("b", 0, 1), ("b", 0, 2)]
    assert rows(incremental.pending(work, done)) == [("b", 0, 2)]


def test_live_audio_after_invalidation(spark):
    made = spark.createDataFrame(
        [("b", 0, 0, 1), ("b", 0, 0, 3), ("b", 1, 0, 1)], "book_id string, index int, n int, run bigint"
    )
    void = spark.createDataFrame([("b", 0, 2)], "book_id string, index int, run bigint")
    assert rows(incremental.live_audio(made, void)) == [("b", 0, 0, 3), ("b", 1, 0, 1)]


def test_chapter_wavs_have_eight_frames_for_each_character(spark, tmp_path):
    from quillspark.plans import catalog

    ship(spark)
    docs = spark.createDataFrame([(1, "One café 😀. " * 90, "s"), (2, "Short.", "s"), (3, None, "s")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    chunks = docs.select("doc_id", F.explode(packing.chunks("text", 500)).alias("c"))
    chars = chunks.groupBy("doc_id").agg(F.sum(F.length("c")).alias("n"))
    got = catalog.QUERIES["chapter_wavs"](spark, str(tmp_path)).groupBy("index").agg(F.sum("frames").alias("f"), F.sum(F.col("wav_bytes") - 44).alias("b"))
    assert {r["index"]: (r.f, r.b) for r in got.collect()} == {r.doc_id: (8 * r.n, 16 * r.n) for r in chars.collect()}
    assert audio.read_wav(synth.CodeSynthesizer(8_000).render("é"))[4] == "é".encode("utf-32-be") * 4


def test_results_of_text_functions_leave_in_slices():
    texts = pa.array(["x" * (SLICE_CHARS // 2), None, "y" * (SLICE_CHARS // 2), "z", ""])
    got = list(in_slices(lambda t: t, texts))
    assert [len(a) for a in got] == [3, 2] and pa.concat_arrays(got).equals(texts)
    assert list(in_slices(lambda t: t, pa.array([], pa.string()))) == []
    assert [a.to_pylist() for a in in_slices(lambda t, n: t * n, pa.array(["a", "b"]), pa.array([2, 3]))] == [["aa", "bbb"]]


def test_texts_are_rewritten_by_arrow_in_slices(spark, capsys):
    ship(spark)
    lex = spark.createDataFrame([("a", "X")], "word string, ipa string")
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "c")], "k long, t string")
    for rows_shipped in (lexicon.SHIP_ROWS, 0):
        out = lexicon.apply_lexicon(docs, "t", lex, ["k"], ship_rows=rows_shipped)
        assert rows(out.select("k", F.coalesce("t", F.lit("null")))) == [(1, "[a](/X/) b"), (2, "null"), (3, ""), (4, "c")]
        out.explain()
    docs.select(encoding.repair_all("t").alias("t")).explain()
    evaluated = re.findall(r"ArrowEvalPython \[.*?\], \[.*?\], (\d+)", capsys.readouterr().out)
    assert set(evaluated) == {"251"}  # Arrow arrays by iterator, not pandas series


def test_shapes_are_asked_of_distinct_words(spark, monkeypatch):
    docs = spark.createDataFrame([("Aa aa bb x1 IV b",), ("aa",), (None,)], "text string")
    counts = vocab.token_counts(docs)
    assert rows(counts) == [("aa", 3), ("bb", 1)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("Aggregate [w")
    tokens = spark.createDataFrame([("b", 0, 0, "Aa", None), ("b", 0, 1, "x1", None)], "book_id string, index int, pos int, text string, ent_type string")
    stats = vocab.spelling_stats(tokens, ["book_id"])
    assert [(r.text, r.n) for r in stats.collect()] == [("Aa", 1)]
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("Aggregate [book_id")
    made = []
    monkeypatch.setattr(vocab, "materialize", lambda df, label="stage": made.append(label) or df)
    assert vocab.zipf_table(counts).count() == 2 and made == ["counts"]
