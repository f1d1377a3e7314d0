import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quillspark.llm import token_files as T
from quillspark.llm.words import raw
from tests.llm.helpers import TOKENIZER, awkward, documents, empty
from tests.llm.test_token_count import ALPHABET

LIBRARY = Tokenizer.from_file(TOKENIZER)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_give_the_library_s_ids(monkeypatch):
    rng = random.Random(8)
    texts = ["", *["".join(rng.choice([*ALPHABET, "that.", "OK!!", "é,"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]]
    for limit in (8_000_000, 500):
        monkeypatch.setattr(T, "CACHE_IDS", limit)
        own = T.Encoder(TOKENIZER)
        for _ in range(2):
            ids, sizes = own.encode(*raw(pa.array(texts)))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            assert all(ids[a:b].tolist() == ids_of(t)[:-1] for a, b, t in zip(bounds, bounds[1:], texts))
    whole, _ = T.Encoder(TOKENIZER, split=False).encode(*raw(pa.array(texts)))
    assert whole.tolist() == ids.tolist()


@pytest.mark.parametrize("encoding,kind", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_round_trip(spark, tmp_path, encoding, kind):
    texts = [f"Some text number {k}. " * (k % 9) for k in range(200)]
    path = str(tmp_path / encoding)
    T.write_tokens(documents(spark, texts), path, TOKENIZER, 2, encoding, row_group_bytes=1 << 16, page_rows=20)
    rows = T.read_tokens(spark, path).orderBy("part", "seq").collect()
    assert [r.doc_id for r in rows] == list(range(200)) and all(r.ids == ids_of(texts[r.doc_id]) for r in rows)
    meta = pq.ParquetFile(next((tmp_path / encoding).glob("*.parquet"))).metadata.row_group(0)
    column = meta.column(meta.num_columns - 1)
    assert kind in column.encodings and column.has_offset_index and meta.column(0).has_column_index
    picked = T.read_tokens(spark, path, "doc_id", "n_tokens").filter("doc_id = 17")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_described_as_read(spark):
    texts = [f"w{k} " * (k % 50) for k in range(300)]
    at = 0
    for r in T.token_files(spark, documents(spark, texts), TOKENIZER, 2).orderBy("doc_id").collect():
        ids = ids_of(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_awkward(spark, tmp_path):
    docs = awkward(spark)
    rows = T.token_files(spark, docs, TOKENIZER, 2).orderBy("start").collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at = 0
    for r, d in zip(rows, order, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (d.doc_id, at, len(ids_of(d.text)))
        at += r.n_tokens
    assert T.token_files(spark, empty(spark), TOKENIZER, 2).count() == 0
    with pytest.raises(ValueError):
        T.write_tokens(docs, str(tmp_path / "x"), TOKENIZER, 2, "unknown")
