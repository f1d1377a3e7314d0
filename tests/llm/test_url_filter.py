import pytest

from quillspark.llm.url_filter import best_rule, filter_urls, hits, automaton, rule_index, split_url, LIMIT, RULES, VOCABULARY
from tests.llm.helpers import clashing

CASES = [
    ("http://a.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://net/x", "net", "/x", "net/", "block"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("https://b.example.com/de/x", "b.example.com", "/de/x", "example.com/de/", "block"),
    ("http://z.net", "z.net", "", None, "allow"),
    ("http://x.org?q=/fr/", "x.org", "", None, "allow"),
    ("x.org/fr/", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"),
    ("http://casino.example.com/", "casino.example.com", "/", None, "block"),
    ("http://casinoworld.example.com/", "casinoworld.example.com", "/", None, "allow"),
    ("http://a.com/free-bet", "a.com", "/free-bet", None, "block"),
    ("http://a.com/free-free", "a.com", "/free-free", None, "allow"),
    ("http://a.com/" + "long" * 5000, "a.com", "/" + "long" * 5000, None, "allow"),
]


def test_cases(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)] * 2
    df = clashing(spark.createDataFrame(rows, "page_id int, url string"), "host", "verdict")
    got = filter_urls(df)
    assert len(got.columns) == len(set(got.columns))
    for r in got.collect():
        assert (r.url, r.host, r.path, r.rule, r.verdict) == CASES[r.page_id]
    assert got.count() == len(rows)


def test_empty_table_and_vocabulary(spark):
    df = spark.createDataFrame([], "page_id int, url string")
    assert filter_urls(df).count() == 0
    with pytest.raises(ValueError):
        filter_urls(df, vocabulary={})


def test_longest_rule_and_terms():
    index = rule_index(RULES)
    assert best_rule(index, "a.b.org", "/fr/x") == ("org/fr/", "allow")
    assert split_url("a://B/c?d") == ("b", "/c")
    found = automaton(VOCABULARY, LIMIT)
    assert hits(found, "http://free.example/free/win") == (0, 2, 2)
    assert hits(found, "http://xxx.example/")[0] == 1
