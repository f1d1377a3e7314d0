import random

from tokenizers import Tokenizer

from quillspark.llm import token_count as T
from tests.llm.helpers import TOKENIZER, awkward, clashing, empty

ALPHABET = [
    "a", "B", " ", "\n", "é", "É", "'", "s", "'S", "1", "²", "_", ".", ",", "###", "İ", "Σ", "ß", "\x85", "\xa0", "​", "\x1c",
    "\x0b", "中", "ﬁ", "<|endoftext|>", "<|startoftext|>", "<", "̀", "ſ", "'ſ", "don't", "I'LL", "'re", "\t", "🏳️", "ǅ", "　",
    "\x00", "J̌", "hello", "the", "ing",
]


def test_counts_equal_the_library():
    rng = random.Random(5)
    texts = ["", *["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)], "ab" * 3000, "é" * 700]
    library = Tokenizer.from_file(TOKENIZER)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert T.Transducer(TOKENIZER).counts(texts).tolist() == want


def test_chunks_of_any_length_agree(monkeypatch):
    texts = ["the quick brown fox", "antidisestablishmentarianism" * 9, "it's 1234 'tis!"]
    own = T.Transducer(TOKENIZER)
    want = own.counts(texts).tolist()
    for size in (1, 3, 7):
        monkeypatch.setattr(T, "CHUNK", size)
        assert own.counts(texts).tolist() == want


def test_rows(spark):
    library = Tokenizer.from_file(TOKENIZER)
    got = T.count_tokens(clashing(awkward(spark), "n_tokens"), TOKENIZER)
    assert len(set(got.columns)) == len(got.columns) and got.count() == awkward(spark).count()
    for r in got.collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert T.count_tokens(empty(spark), TOKENIZER).count() == 0
