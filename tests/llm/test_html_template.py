import collections
import os
import re

from quillspark.llm import html_template as H
from quillspark.llm.html_template import extract, main_text, parse, templates
from tests.llm.helpers import clashing

NONE = (set(), set(), set())
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use</div><nav><a href=x>m</a></nav><main><article class=post><h1>T &amp; t</h1>
<p>one <b>two</b><br>three<script>x</p></script> four<p>five <a href=#>link</a><ul><li>a<li>b</ul>
<table><tr><td>c1<td>c2<tr><td>c3</table><form><p>no</form><div class="ad-slot">ad</div><aside>no</aside>
<section class="comments"><p>nope</section></article></main><aside class=sidebar>s</aside><footer>x</footer></body></html>"""


def text_of(source):
    return main_text(parse(source), *NONE)


def test_article():
    assert text_of(PAGE) == "T & t\none two three four\nfive link\na\nb\nc1\nc2\nc3"


def test_broken_markup():
    assert text_of("") == "" and text_of("<") == "<" and text_of("a < b") == "a < b"
    assert text_of("<article><p>cut off &am") == "cut off &am"
    assert text_of("<article><p>x</p><p") == "x"
    assert text_of("<article><p>&#65;&#x42; \n  c&nbsp;d</p>") == "AB c d"
    assert text_of("<p title='a > b'>q</p><!-- <p>no</p> -->") == "q"
    assert len(text_of("<article>" + "<p>w" * 20_000)) == 39_999


def test_names_about_the_page():
    assert text_of('<div class="page has-sidebar"><article><p>x</p><div class="left sidebar">y</div></article></div>') == "x"
    assert text_of('<article><section id="commentSection">y</section><p class="loading">x</p></article>') in ("x", "y\nx")


def test_host_template(spark):
    """Without article marks, what repeats on a host and menus are left out."""
    rows = [
        (i, f"http://h.example/{i}",
         f"<html><body><div class=x1><a href=a>Home {i}</a><a href=b>News</a></div><div class=x2><p>Welcome to us</p><p>Call now</p></div>"
         f"<div class=x3><p>story {i} begins</p><p>and ends with {i * 7}</p></div></body></html>")
        for i in range(8)
    ]
    df = clashing(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4), "text")
    found = templates(df).collect()
    assert len(found) == 1 and len(found[0].texts) >= 2 and len(found[0].menus) == 1
    for r in extract(df).collect():
        assert r.text == f"story {r.page_id} begins\nand ends with {r.page_id * 7}" and r.n_chars == len(r.text)


def words(*parts):
    return " ".join(f"{a}{b}" for a in parts for b in "abcdefgh")


def test_template_decides_around_articles(spark):
    """A host's own text inside articles goes, a slot outside them stays."""
    rows = [
        (i, f"http://h.example/{i}",
         f"<body><div class=x1><a href=a>Home {i}</a></div><article><p>story {i} {words(i)}</p><div class=x2><p>Please read our terms</p>"
         f"<p>All rights are ours</p></div><p>it ends with {i * 7}</p></article><div class=x3><p>afterword {i} of it</p></div></body>")
        for i in range(8)
    ]
    for r in extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)).collect():
        i = r.page_id
        assert r.text == f"story {i} {words(i)}\nit ends with {i * 7}\nafterword {i} of it"


def test_copies_are_no_template(spark):
    """Copies of a page under other addresses and with other links count once, with and without article marks."""
    story = [words(f"c{k}") for k in range(4)]
    for open_, close in (("<article>", "</article>"), ("<div class=x3>", "</div>")):
        page = lambda i, ps: f"<body><div class=x1><a href=a>Home {i}</a></div>{open_}<h1>{ps[0]}</h1>" + "".join(f"<p>{p}</p>" for p in ps[1:]) + f"{close}</body>"
        texts = [story] * 6 + [[words(f"o{i}"), words(f"p{i}")] for i in range(4)]
        rows = [(i, f"http://h.example/{i}", page(i, ps)) for i, ps in enumerate(texts)]
        for r in extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)).collect():
            assert r.text == "\n".join(texts[r.page_id])


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "nothing", ""), (None, "http://h/", PAGE), (3, "http://h/", PAGE), (3, "http://h/", PAGE)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = extract(df).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got)[:2] == [0, 0] and all(r.text is not None for r in got)
    assert extract(df.limit(0)).count() == 0


def host(url):
    found = re.search("://([^/?#]*)", url or "")
    return found[1].lower() if found else ""


def plain_templates(rows):
    """Templates of each host, token by token and page by page."""
    pages = collections.defaultdict(dict)
    for r in rows:
        page = parse(r["html"] or "")
        tokens = pages[host(r["url"])].setdefault(H.content_number(page), {})
        for token, parent, kind, *values in H.page_tokens(page):
            key = (token, parent, kind)
            tokens[key] = [max(a, b) for a, b in zip(tokens[key], values)] if key in tokens else values
    out = {}
    for name, contents in pages.items():
        seen = collections.defaultdict(list)
        for tokens in contents.values():
            for key, values in tokens.items():
                seen[key].append(values)
        occurs = {k: (sum(v[0] for v in vs), len(vs)) for k, vs in seen.items() if k[2] != 2 and len(vs) >= max(3, len(contents) / 2)}
        size = collections.Counter(occurs.values())
        member = {k for k, v in occurs.items() if size[v] >= 3}
        elements = {k[0] for k in member if k[2] != 1}
        valid = [k for k in member if k[2] == 1 or k[1] == 0 or k[1] in elements]
        rows_of = [
            dict(token=k[0], parent=k[1], kind=k[2], pages=len(seen[k]), texts=len({v[4] for v in seen[k]}),
                 **{c: sum(v[i] for v in seen[k]) for i, c in ((1, "chars"), (2, "linked"), (3, "held"))})
            for k in valid if k[2] != 1
        ]
        main, sides, bare = H.judge(rows_of, sum(v[3] for v in seen[(0, 0, 2)]))
        if valid:
            lists = ([m["token"] for m in rows_of], [k[0] for k in valid if k[2] == 1], H.menus_of(rows_of), sides, bare)
            out[name] = (*map(frozenset, lists), main)
    return out


def given(spark, sf_dir):
    return spark.read.parquet(os.path.join(os.path.dirname(sf_dir), "sf0.01", "pages.parquet"))


def test_templates_equal_brute_force(spark, sf_dir):
    rows = given(spark, sf_dir)
    want = plain_templates([r.asDict() for r in rows.collect()])
    got = {r.host: (*[frozenset(r[c]) for c in H.LISTS], r.main) for r in templates(rows.repartition(5)).collect()}
    assert got == want and want


def test_template_needs_no_marks(spark, sf_dir, monkeypatch):
    """Without class words and article marks the given pages' hosts with a template give the same text."""
    rows = [r.asDict() for r in given(spark, sf_dir).collect()]
    known = {r.page_id: r.text for r in extract(given(spark, sf_dir)).collect()}
    monkeypatch.setattr(H, "_OUT_WORDS", frozenset())
    monkeypatch.setattr(H, "_MAIN_WORDS", frozenset())
    monkeypatch.setattr(H, "_MAIN_TAGS", frozenset())
    found = plain_templates(rows)
    asked = [r for r in rows if host(r["url"]) in found]
    assert len(asked) > len(rows) / 2
    for r in asked:
        assert main_text(parse(r["html"] or ""), *found[host(r["url"])]) == known[r["page_id"]]


HEAD = "<html><head><meta charset=utf-8></head><body>"


def layout(i, extra="", story=None):
    return (
        f"{HEAD}<div class=k1><a href=a>Home {i}</a></div><div class=k2>Buy {'tea' if i % 3 else 'jam'} today</div>"
        f"<div class=k3><h1>Title {i}</h1><p>{story or words(f's{i}', f't{i}')}</p>{extra}</div><div class=k4>{i} likes</div></body>"
    )


def test_slots_are_judged(spark):
    """Beside the main slot short and repeated texts go, headings and long ones stay; other layouts go by marks."""
    pages = [layout(i) for i in range(12)]
    pages.append(f"{HEAD}<section><article><p>another layout</p></article><p>below it</p></section></body>")
    pages.append(layout(50).replace("<div class=k3>", f"<h2>Above 50</h2><div class=k9>{words('q', 'r')}</div><div class=k3>"))
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\n{words(f's{i}', f't{i}')}"
    assert got[12] == "another layout"
    assert got[13].endswith(f"Title 50\n{words('s50', 't50')}")
