"""Main text of web pages by templates deduced for each host.

The tokens of a page are its elements, known by the path of tags and classes that leads to them, and its text
blocks together with that path.  Tokens with one occurrence vector over the pages of a host form an equivalence
class.  Large, frequent classes whose elements nest make up the host's template; what lies between
template tokens are slots.  The main slot is the smallest that holds most of the host's own text; a slot beside it is content
if its texts differ from page to page and are long enough beside the main ones, or if it is a heading.  Slots of menus,
notices and the like and the template's own text are not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.scale import materialize, sized_join

LEAST_PAGES = 3  # pages a template token must occur on
LEAST_SHARE = 0.5  # and the share of the host's pages
LEAST_TOKENS = 3  # tokens in a class
MENU_LINKS = 0.6  # share of a slot's text in links that makes it a menu
MAIN_SHARE = 0.5  # of its parent's text that a slot on the way to the main slot holds
BESIDE = 0.15  # length of a slot's text beside the main one's that makes it content
DIFFERENT = 0.5  # distinct texts a page that a slot of content has
SAME_TEXT = 0.9  # pages of a host whose longest blocks, up to this share of their text, are equal count once

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z/!?][^>]*+\Z|[^<]++|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = {n: re.compile(rf"</{n}\b[^>]*>?", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option optgroup p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES = {  # an opening tag that ends an open element, up to the element it stays within
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_FENCE = frozenset(["td", "th", "table", "button", "html", "body"])  # open paragraphs beyond these stay open
_OUT_TAGS = frozenset(
    "nav footer aside form script style noscript template head button select datalist textarea iframe object svg "
    "math canvas audio video dialog title menu search noembed noframes".split()
)
_OUT_WORDS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments "
    "disqus respond replies share sharing social related recommended newsletter subscribe subscription signup login "
    "search footer masthead toolbar pagination pager widget skip".split()
)
# Words that make a name say something about the page: "has-sidebar" is no sidebar.
_ABOUT = frozenset("has with no without layout wrapper container page body content".split())
_OUT_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"])
_MAIN_TAGS = frozenset(["article", "main"])
_MAIN_WORDS = frozenset(["articlebody", "article", "post", "entry", "story"])


@dataclass
class Block:
    """Text between two block boundaries."""

    text: str
    path: int  # of the element it lies in
    out: bool  # in an element that never holds main text
    main: bool  # in an article or main element
    linked: int  # characters in links


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: dict[int, list[int]] = field(default_factory=dict)  # path -> [occurrences, parent path]
    headings: set[int] = field(default_factory=set)  # paths of h1 to h6


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace")) - 2**63


def _named(attributes: str) -> tuple[str, bool, bool]:
    """Signature of an element's attributes, and whether they speak against or for main text."""
    sign, out, main = [], False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("hidden", "aria-hidden"):
            out = out or (name == "hidden" or value == "true")
            continue
        words = {w.lower() for w in _WORD.findall(value)}
        if name == "role":
            out, main = out or value.lower() in _OUT_ROLES, main or value.lower() in ("main", "article")
        else:
            names = value.split() if name != "itemprop" else []
            parts = [{w.lower() for w in _WORD.findall(n)} for n in names]
            out = out or any(p & _OUT_WORDS and not p & _ABOUT for p in parts)
            main = main or value.lower() in _MAIN_WORDS
        if name != "id" or not any(w.isdigit() for w in words):
            sign.append(f"{name}={value}")
    return ";".join(sign), out, main


def parse(source: str) -> Page:
    """Blocks and elements of a page; unclosed, misnested and cut-off tags are taken as browsers do, roughly."""
    page, buffer, linked = Page(), [], 0
    # name, path, out, main, in a link
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    names: dict[tuple[int, str, str], tuple[int, bool, bool]] = {}
    here = stack[0]

    def flush(at: tuple[str, int, bool, bool, bool]) -> None:
        nonlocal buffer, linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                page.blocks.append(Block(text, at[1], at[2], at[3], linked))
            buffer, linked = [], 0

    def close(depth: int) -> None:
        nonlocal here
        if any(e[0] in _BLOCK or e[2] != here[2] for e in stack[depth:]):
            flush(block_of())
        del stack[depth:]
        here = stack[-1]

    def block_of() -> tuple[str, int, bool, bool, bool]:
        for e in reversed(stack):
            if e[0] in _BLOCK or not e[0]:
                return e
        return stack[0]

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                if not here[2]:
                    buffer.append(text)
                    linked += len(text.strip()) if here[4] else 0
                elif block_of()[2]:
                    buffer.append(text)
            continue
        name, attributes = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if name == "p" or name in _BLOCK:
                flush(block_of())
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if stack[depth][0] in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "div", "article", "section", "main", "td", "th"):
                    break
            continue
        if name == "br" or name == "wbr":
            buffer.append(" " if name == "br" else "")
            continue
        if name in _BLOCK:
            flush(block_of())
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in _FENCE:
                    break
        if name in _CLOSES:
            ends, within = _CLOSES[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ends:
                    close(depth)
                    if name != "tr":
                        break
                elif stack[depth][0] in within:
                    break
        key = (here[1], name, attributes)
        known = names.get(key)
        if known is None:
            sign, out, main = _named(attributes) if attributes.strip() else ("", False, False)
            known = names[key] = (_hash(here[1], name, sign), out or name in _OUT_TAGS, main or name in _MAIN_TAGS)
        path, out, main = known
        if name == "header" and not here[3]:
            out = True
        if name in ("html", "body"):
            out = False
        seen = page.elements.get(path)
        if seen is None:
            page.elements[path] = [1, here[1]]
            if name in _HEADINGS:
                page.headings.add(path)
        else:
            seen[0] += 1
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK and name not in _RAW:
            continue
        if name in _RAW:
            over = _RAW[name].search(source, at)
            at = over.end() if over else end
            continue
        new = (name, path, here[2] or out, here[3] or main, here[4] or name == "a")
        stack.append(new)
        here = new
    flush(block_of())
    return page


def host_of(url: str) -> Column:
    """Lower-cased host; empty for a null or a URL without ``://``."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1))


def _text_token(block: Block) -> int:
    return _hash("text", block.path, block.text)


def content_number(page: Page) -> int:
    """One number for what a page says: the longest of its blocks that may be content, in any order."""
    blocks = [b for b in page.blocks if not b.out and b.linked < len(b.text) * MENU_LINKS]
    blocks = [b for b in blocks if b.main] or blocks or page.blocks
    texts = sorted({b.text for b in blocks}, key=lambda t: (-len(t), t))
    taken, left = [], SAME_TEXT * sum(map(len, texts))
    for text in texts:
        if left <= 0:
            break
        taken.append(text)
        left -= len(text)
    return _hash("content", *taken)


LISTS = ("elements", "texts", "menus", "sides", "bare")  # of a template
TOKEN_COLUMNS = "token long, parent long, kind int, vector long, chars long, linked long, held long, said long"


def page_tokens(page: Page) -> Iterator[tuple[int, ...]]:
    """The tokens of a page, as ``TOKEN_COLUMNS``: an element (kind 0, a heading 3), a text (1) and the page itself (2).

    ``chars`` and ``linked`` count the text that stands in an element itself; ``held`` counts all below it that
    may be content, links apart, and ``said`` is a number for that text.  ``vector`` is a number for the page's content
    and the token's occurrences in it; its sum over pages stands for the occurrence vector.
    """
    own = content_number(page)
    chars: dict[int, list[int]] = {}
    held: dict[int, list[int]] = {}
    texts: dict[int, list[int]] = {}
    for block in page.blocks:
        size = chars.setdefault(block.path, [0, 0])
        size[0] += len(block.text)
        size[1] += block.linked
        token = _text_token(block)
        texts.setdefault(token, [0, block.path])[0] += 1
        if block.out or block.linked >= len(block.text) * MENU_LINKS:
            continue
        path, said = block.path, _hash("said", block.text)
        while True:
            below = held.setdefault(path, [0, 0])
            below[0] += len(block.text)
            below[1] = (below[1] * 31 + said) % 2**61
            if path not in page.elements:
                break
            path = page.elements[path][1]
    rows = [(0, 0, 2, 1)]
    rows += [(t, parent, 3 if t in page.headings else 0, n) for t, (n, parent) in page.elements.items()]
    rows += [(t, parent, 1, n) for t, (n, parent) in texts.items()]
    for token, parent, kind, n in rows:
        vector = xxhash.xxh64_intdigest(own.to_bytes(8, signed=True) + n.to_bytes(8)) >> 24
        sizes = (*chars.get(token, (0, 0)), *held.get(token, (0, 0))) if kind != 1 else (0, 0, 0, 0)
        yield token, parent, kind, vector, *sizes


def tokens(pages: DataFrame) -> DataFrame:
    """(host, content) and ``TOKEN_COLUMNS``, one row per token of each page."""
    schema = f"host string, content long, {TOKEN_COLUMNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for host, source in zip(*(c.to_pylist() for c in batch.columns)):
                page = parse(source or "")
                own = content_number(page)
                for row in page_tokens(page):
                    for column, value in zip(out, (host, own, *row)):
                        column.append(value)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=[c.split()[0] for c in schema.split(", ")]
            )

    return pages.select(host_of("url").alias("host"), "html").mapInArrow(run, schema)


def judge(members: list[dict], all_held: int) -> tuple[int, list[int], list[int]]:
    """Main slot, slots of no content and bare elements among a host's template elements; its pages hold ``all_held`` text.

    From the page down, the child with at least ``MAIN_SHARE`` of the text is taken, as long as it is a container: an element that
    mostly holds text itself is one of the main slot's parts.  What an element on this way holds beside its template
    elements is a slot too; the element is bare if that is no content.
    """
    children: dict[int, list[dict]] = {}
    for m in members:
        children.setdefault(m["parent"], []).append(m)
    way, main, held = [], 0, all_held
    while True:
        best = max(children.get(main, ()), key=lambda m: (m["held"], -m["token"]), default=None)
        if best is None or best["held"] < held * MAIN_SHARE or not held or best["chars"] * 2 > best["held"]:
            break
        way.append((main, held, best["token"]))
        main, held = best["token"], best["held"]
    sides, bare = [], []
    for at, all_of_it, next_ in way:
        rest = all_of_it
        for m in children[at]:
            rest -= m["held"]
            long_enough = m["kind"] == 3 or m["held"] >= held * BESIDE
            if m["token"] != next_ and not (long_enough and m["texts"] >= m["pages"] * DIFFERENT):
                sides.append(m["token"])
        if rest < held * BESIDE:
            bare.append(at)
    for m in children.get(main, ()):
        if m["texts"] < m["pages"] * DIFFERENT and m["held"]:
            sides.append(m["token"])
    return main, sides, bare


def templates(pages: DataFrame) -> DataFrame:
    """(host, elements, texts, menus, sides, bare, main): the tokens of each host's template, and how its slots are judged.

    Pages of one content are one page with the tokens of them all: copies don't make an article a template.  Occurrence
    vectors are then summed before the shuffle, so a host with a third of all pages costs no more than its
    template in one task.  A class counts if it is large and frequent enough and valid: an element needs its
    parent in the template too.
    """
    sums = [F.sum(c).alias(c) for c in ("vector", "pages", "chars", "linked", "held")]
    summed = materialize(
        tokens(pages)
        .groupBy("host", "content", "token", "parent", "kind")
        .agg(*[F.max(c).alias(c) for c in ("vector", "chars", "linked", "held", "said")])
        .withColumn("pages", F.lit(1))
        # Equal texts of a slot first, so that the number of different ones is a count of rows.
        .groupBy("host", "token", "parent", "kind", "said").agg(*sums)
        .groupBy("host", "token", "parent", "kind").agg(*sums, F.count(F.lit(1)).alias("said")),
        "page-tokens",
    )
    sizes = summed.filter("kind = 2").select("host", F.col("pages").alias("all_pages"), F.col("held").alias("all_held"))
    frequent = (
        summed.filter((F.col("kind") != 2) & (F.col("pages") >= LEAST_PAGES))
        .join(sizes, "host")
        .filter(F.col("pages") >= F.col("all_pages") * LEAST_SHARE)
    )
    classes = frequent.groupBy("host", "vector", "pages").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TOKENS)
    member = frequent.join(classes.drop("n"), ["host", "vector", "pages"])
    above = member.filter("kind <> 1").select("host", F.col("token").alias("parent"))
    nested = member.filter("kind <> 1").join(above, ["host", "parent"], "left_semi")
    # The element around a text may occur more often than the text.
    valid = nested.unionByName(member.filter("kind = 1 or parent = 0"))
    element = F.struct("token", "parent", "kind", "chars", "linked", "held", "pages", F.col("said").alias("texts"))
    found = valid.groupBy("host").agg(
        F.collect_list(F.when(F.col("kind") != 1, element)).alias("members"),
        F.collect_list(F.when(F.col("kind") == 1, F.col("token"))).alias("texts"),
        F.max("all_held").alias("all_held"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for r in batch.to_pylist():
                main, sides, bare = judge(r["members"], r["all_held"])
                row = (r["host"], [m["token"] for m in r["members"]], r["texts"], menus_of(r["members"]), sides, bare, main)
                for column, value in zip(out, row):
                    column.append(value)
            types = (pa.string(), *[pa.list_(pa.int64())] * 5, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["host", *LISTS, "main"]
            )

    lists = ", ".join(f"{c} array<long>" for c in LISTS)
    return found.mapInArrow(run, f"host string, {lists}, main long")


def menus_of(members: list[dict]) -> list[int]:
    """Elements whose own text stands mostly in links."""
    return [m["token"] for m in members if m["chars"] and m["linked"] >= m["chars"] * MENU_LINKS]


def main_text(page: Page, elements=frozenset(), texts=frozenset(), menus=frozenset(), sides=frozenset(), bare=frozenset(), main: int = 0) -> str:
    """Blocks of the page's content slots, one to a line.

    A block belongs to the innermost template element around it.  The slots' evidence decides: the template's text, slots of
    no content, and blocks mostly made of links go, and within the main slot only such links as stand in menus.  On a page
    without the host's main slot, or of a host without a template, an article's marks tell what is content.
    """
    placed = bool(elements) and (not main or main in page.elements)
    inner = any(b.main and not b.out for b in page.blocks)
    kept = []
    for block in page.blocks:
        if block.out or _text_token(block) in texts:
            continue
        if inner and not block.main and not placed:
            continue
        around, at = [], block.path
        while at in page.elements:
            around.append(at)
            at = page.elements[at][1]
        slot = next((e for e in around if e in elements), 0)
        if placed and (slot in bare or not sides.isdisjoint(around)):
            continue
        links = block.linked >= len(block.text) * MENU_LINKS
        within = main in around if placed and main else block.main
        if (slot in menus and links) if within else (slot in menus or links):
            continue
        kept.append(block.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Rows of ``pages`` with ``text`` and ``n_chars`` added; a null or empty html gives an empty text.

    Pages of equal content count once in the deduction.  Columns of ``pages`` named like an added one are replaced.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    names = [f"_{i}" for i in range(len(kept))]
    renamed = pages.select(*[pages[f"`{c}`"].alias(n) for c, n in zip(kept, names)])
    host = host_of(names[kept.index("url")])
    found = materialize(templates(pages), "templates").withColumnRenamed("host", "_host")
    joined = sized_join(renamed.withColumn("_host", host), found, ["_host"], "left")
    at = kept.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            hosts = batch.column("_host").to_pylist()
            for i, source in enumerate(batch.column(names[at]).to_pylist()):
                if hosts[i] not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    lists = [frozenset(batch.column(c)[i].as_py() or ()) for c in LISTS]
                    sets[hosts[i]] = (*lists, batch.column("main")[i].as_py() or 0)
                texts.append(main_text(parse(source or ""), *sets[hosts[i]]))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=[*names, "_text", "_chars"],
            )

    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in names)
    out = joined.select(*names, "_host", *LISTS, "main").mapInArrow(run, f"{schema}, _text string, _chars long")
    return out.select(
        *[out[n].alias(c) for c, n in zip(kept, names)], out["_text"].alias("text"), out["_chars"].alias("n_chars")
    )
