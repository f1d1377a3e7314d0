"""The registered queries on the given tables, and the pipeline's stages."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline as P
from quillspark.llm import adapt_join, lsi
from quillspark.llm.catalog import ORACLES, QUERIES
from quillspark.operators.scale import materialize
from tests.compare import connect, differences
from tests.llm.helpers import TOKENIZER, awkward, empty
from tests.llm.test_adapt_join import brute

COLUMNS = {
    "op1_url_filter": "page_id host path rule verdict", "op2_token_count": "doc_id n_bytes n_tokens over_limit",
    "op3_html_template": "page_id url text n_chars", "op4_quality": "doc_id held_out score predicted",
    "op5_brown_lm": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6_latent_search": "doc_id item_id",
    "op7_jaccard_join": "doc_id n_shingles component_id", "op8_mix": "doc_id size source_size target taken",
    "op9_order_minhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_inner_top": "query_id rank vec_id score", "op12_dual_tree": "item_id rank doc_id score",
    "op13_whitening": "vec_id component n deviation whitened explained identity_error",
    "op10_token_files": "doc_id start n_tokens ids_crc32", "pipeline": "doc_id start n_tokens ids_crc32",
}


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES) and set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_runs_over_the_whole_table(spark, sf_dir, name):
    got = materialize(contract.queries()[name](spark, sf_dir), "result")
    assert set(COLUMNS[name].split()) <= set(got.columns)
    if name in ORACLES:
        assert differences(got, connect(sf_dir), ORACLES[name]) == ""
    if name == "op13_whitening":
        assert got.count() == 8 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    elif name not in ("op6_latent_search", "op11_inner_top", "op12_dual_tree", "pipeline"):
        of = "pages" if name in ("op1_url_filter", "op3_html_template") else "documents"
        assert got.count() == spark.read.parquet(f"{sf_dir}/{of}.parquet").count()


def test_token_counts_and_links(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    library = Tokenizer.from_file(TOKENIZER)
    for r in contract.queries()["op2_token_count"](spark, sf_dir).join(docs, "doc_id").collect():
        assert (r.n_bytes, r.n_tokens) == (len(r.text.encode()), len(library.encode(r.text, add_special_tokens=False).ids))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, adapt_join.near_duplicates(docs).collect())) == sorted(brute(rows))


def test_every_leak_is_found(spark, sf_dir):
    plain = lambda t: " " + " ".join(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", t).lower().split()) + " "
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {(d, i) for d, text in docs for i, item in items if item in text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_latent_search"](spark, sf_dir).collect()}
    assert want and got == want


def test_stages(spark, sf_dir):
    """Each stage's decisions against brute force on what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    good = materialize(P.quality_stage(spark, docs, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = good.join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert good.columns == columns and kept > 0.97
    single = materialize(P.near_duplicate_stage(spark, good, sf_dir))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, n, c in brute(rows) if n})
    clean = materialize(P.decontamination_stage(spark, single, sf_dir))
    leaks = {r.doc_id for r in lsi.contaminated(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaks
    mixed = materialize(P.mixing_stage(spark, clean, sf_dir))
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert P.token_stage(spark, mixed, sf_dir).count() == mixed.count()


def test_stages_take_awkward_tables(spark, sf_dir):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in P.STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert P.token_stage(spark, docs, sf_dir).count() == docs.count()


def test_tokens_stand_in_mixed_order(spark, sf_dir, tmp_path):
    """Token files follow the order of the files they are made from, not the ids."""
    path = tmp_path / "mixed"
    P.mixing_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).repartition(5).write.parquet(str(path))
    ids = [i for f in sorted(path.glob("*.parquet")) for i in pq.read_table(f).column("doc_id").to_pylist()]
    got = P.token_stage(spark, spark.read.parquet(str(path)), sf_dir).orderBy("start").collect()
    assert [r.doc_id for r in got if r.n_tokens] == ids and ids != sorted(ids)


def test_one_row_of_each_group_stays(spark, sf_dir):
    docs = awkward(spark)
    got = P.near_duplicate_stage(spark, docs, sf_dir)
    texts = [r.text for r in got.collect()]
    assert texts.count("one") == 1 and got.filter("text is null or trim(text) = ''").count() >= 3
    assert texts.count("a text without an id but with words") == 1


def test_files_are_taken_by_number(spark, sf_dir, tmp_path):
    path = tmp_path / "many"
    path.mkdir()
    for at, number in enumerate(("99999", "100000")):
        one = spark.createDataFrame([(9 - at, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
        pq.write_table(one.toArrow(), path / f"part-{number}-x.parquet")
    got = P.token_stage(spark, spark.read.parquet(str(path)), sf_dir).orderBy("start").collect()
    assert [r.doc_id for r in got] == [9, 8]


def test_settings_of_the_session_are_left(spark, sf_dir, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []

    def look(session, docs, _):
        seen.append(session.conf.get(name))
        return docs

    monkeypatch.setattr(P, "STAGES", [("look", look)])
    assert P.run(spark, sf_dir).count() and seen == [P.ARROW_ROWS] and spark.conf.get(name) == before
    monkeypatch.setattr(P, "STAGES", [("fail", lambda *_: 1 / 0)])
    with pytest.raises(ZeroDivisionError):
        P.run(spark, sf_dir)
    assert spark.conf.get(name) == before
