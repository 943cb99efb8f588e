"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks of text at block-level tags. A block's features are its own word count and link density, those
of the blocks before and behind it, and what it stands in: an article, an element that by its tag holds menus, notices,
comments and the like, or a form or a wrapper that by words of its class and id does, unless that is around most of the
page. An article starts afresh, what is around it doesn't count. A decision tree, grown on the small labelled pages
below, says which blocks are content. Pages don't depend on each other, so the work is one pass of tasks over batches.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.boosting import grow, walk
from mailloom.llm.common import fresh, text_of

#: Elements whose text isn't the page's. What is in RAW ones is no markup: they go to their end tag or the page's end.
RAW = "script|style|noscript|textarea|iframe|title"
SILENT = "template|select|svg|object|button|canvas|video|audio"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])([^>]*+)>"
    rf"""|<({SILENT})(?=[\s/>])((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(</?[a-zA-Z][^>]*+>)|<[!?/][^>]*+>""",
    re.S | re.I)
#: The same where a quote was found that nothing closes: from there on, tags end at the next ">".
LOOSE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])([^>]*+)>|<({SILENT})(?=[\s/>])([^>]*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|(</?[a-zA-Z][^>]*+>)|<[!?/][^>]*+>", re.S | re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW.split("|")}
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup p pre section summary table tbody "
    "tfoot thead tr ul".split())
#: Inline elements that part words.
SPACE = frozenset("br td th img input".split())
ARTICLE = frozenset("article main".split())
BOILER = frozenset("nav footer aside menu dialog".split())
#: No article starts afresh in these.
SHUT = frozenset("nav footer aside".split())
#: Boilerplate but in an article.
HEADERS = frozenset("header hgroup address".split())
#: Elements that hold short pieces of running text.
ITEMS = frozenset("li dt dd pre blockquote figcaption".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notification pager pagination popup promo promotion recommended related reply replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget".split())
#: Hints of comment lists, where each comment may be an article, and of lists of teasers.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
TEASERS = frozenset("promo promotion recommended related sponsor sponsored teaser".split())
#: A wrapper with more than this share of the page's words outside is boilerplate; one around most of the page is layout.
OUTSIDE = 0.4
STATE = re.compile(r"(?:has|no|with|without|show)[-_]")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
SHUT_ROLES = frozenset("navigation contentinfo complementary".split())


class Mark(NamedTuple):
    """An open silent element, and what there was where it starts."""

    name: str
    depth: int
    found: int
    pieces: list[str]
    size: int
    linked: int
    heading: bool
    quiet: bool
    bounds: int
    open_p: int
    open_a: int


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    boiler: bool
    article: bool
    heading: bool
    item: bool = False
    outside: float = 0.0


class Place(NamedTuple):
    """What a block stands in: shut places have no articles of their own; wrapper counts unless an article is below it,
    owner is the innermost wrapper anyway; teasers says that wrapper lists teasers."""

    boiler: bool = False
    article: bool = False
    shut: bool = False
    teasers: bool = False
    wrapper: int = -1
    owner: int = -1


def hints(name: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool, bool]:
    """(boiler, shut, wrapper, teasers) of an element, by its tag or attributes."""
    boiler, shut, wrapper = name in BOILER or (name in HEADERS and not in_article), name in SHUT, name == "form"
    teasers = False
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return boiler, shut, wrapper, teasers
    if HIDDEN.search(attributes):
        return True, True, wrapper, teasers
    if name in ("body", "html", "article", "main"):
        return boiler, shut, wrapper, teasers
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if key.lower() == "role":
            boiler, shut = boiler or value.lower() in ROLES, shut or value.lower() in SHUT_ROLES
            wrapper = wrapper or value.lower() == "form"
            continue
        for one in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
            parts = set(re.split(r"[^a-z]+", one)) & HINTS
            if parts & COMMENTS and not STATE.match(one):
                boiler = shut = True
            wrapper = wrapper or bool(parts - {"header"} or parts and not in_article)
            teasers = teasers or bool(parts & TEASERS)
    return boiler, shut, wrapper, teasers


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order. References are decoded, white space is one space, empty blocks are none.

    What a silent element holds goes when its end tag comes. One without an end tag ends with what holds it, and only
    its text up to the next block goes.
    """
    found: list[tuple[Block, Place]] = []
    stack: list[tuple[str, Place]] = []
    parents: list[int] = []
    open_: Counter[str] = Counter()
    pieces: list[str] = []
    linked, heading = 0, False
    place = Place()
    marks: list[Mark] = []
    quiet, bounds = False, 0
    endless: set[str] = set()

    def flush() -> None:
        nonlocal pieces, linked, heading
        words = "".join(pieces).split()
        if words:
            found.append((
                Block(" ".join(words), len(words), min(linked, len(words)), place.boiler, place.article, heading,
                      any(open_[x] > 0 for x in ITEMS)), place))
        pieces, linked, heading = [], 0, False

    def pop(name: str) -> None:
        nonlocal place, quiet, bounds, pieces, linked, heading
        while stack:
            last, place = stack.pop()
            open_[last] -= 1
            if marks and marks[-1].depth == len(stack):
                mark = marks.pop()
                if last == name:
                    del found[mark.found:]
                    pieces, linked, heading, quiet, bounds = mark.pieces, mark.linked, mark.heading, mark.quiet, mark.bounds
                    del pieces[mark.size:]
                elif bounds == mark.bounds:
                    quiet = mark.quiet
            if last == name:
                return

    def within(name: str) -> bool:
        """Whether such an element is open in the innermost silent one, or in the page if none is open."""
        return open_[name] > (getattr(marks[-1], f"open_{name}") if marks else 0)

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not quiet:
            decoded = html.unescape(raw) if "&" in raw else raw
            pieces.append(decoded)
            if open_["a"]:
                linked += len(decoded.split())

    # Behind the last ">" no tag ends, so none is looked for there; a comment may still start, and then goes on to the end.
    at, last, pattern = 0, page.rfind(">") + 1, TOKEN
    while token := pattern.search(page, at, last):
        text(page[at: token.start()])
        at = token.end()
        raw, _, silent, _, slash, name, _, unclosed = token.groups()
        if unclosed:
            pattern = LOOSE
        if at == last and token[0].startswith("<!--") and not token[0].endswith("-->"):
            at = len(page)
        name = (raw or silent or name or "").lower()
        attributes = token[2] or token[4] or token[7] or ""
        if not name:
            continue
        if raw and not (quiet and marks[-1].name in FOREIGN):
            if name not in endless:
                end = RAW_END[name].search(page, at)
                if end:
                    at = end.end()
                elif name == "noscript":
                    endless.add(name)
                else:
                    at = len(page)
            continue
        if name in BLOCK:
            flush()
            quiet = False
            bounds += 1
        elif name in SPACE and not quiet:
            pieces.append(" ")
        if slash:
            if open_[name]:
                pop(name)
            continue
        if name == "a" and within("a"):
            pop("a")
        if name in BLOCK and within("p"):
            pop("p")
        heading = heading or not quiet and name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in VOID or attributes.endswith("/"):
            continue
        if silent:
            marks.append(Mark(name, len(stack), len(found), pieces, len(pieces), linked, heading, quiet, bounds, open_["p"], open_["a"]))
            quiet = True
        stack.append((name, place))
        open_[name] += 1
        boiler, shut, wrapper, teasers = hints(name, attributes, place.article)
        if name in ARTICLE and not place.shut and not shut:
            listed = place.teasers and name != "main"
            place = Place(article=True, teasers=listed, wrapper=place.wrapper if listed else -1, owner=place.owner)
        elif name in ARTICLE or boiler or shut or wrapper:
            if wrapper:
                parents.append(place.owner)
                place = place._replace(wrapper=len(parents) - 1, owner=len(parents) - 1, teasers=teasers)
            place = place._replace(
                boiler=place.boiler or boiler, shut=place.shut or shut, article=place.article or name in ARTICLE)
    rest = page[max(at, last):].split("<!--", 1)[0] if at <= last else page[at:]
    text(page[at: last] + rest if at < last else rest)
    flush()
    total, sizes = sum(b.words for b, _ in found), [0] * len(parents)
    for block, at_ in found:
        if at_.owner >= 0:
            sizes[at_.owner] += block.words
    for i in reversed(range(len(parents))):
        if parents[i] >= 0:
            sizes[parents[i]] += sizes[i]
    return [b if p.wrapper < 0 else b._replace(outside=1 - sizes[p.wrapper] / total) for b, p in found]


def features(found: list[Block]) -> np.ndarray:
    """A row per block: words and link density of the block, of the one before and the one behind; place; heading; item."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    density = np.array([b.linked for b in found], float) / np.maximum(words, 1)
    rows = np.zeros((n, 10))
    rows[:, 0], rows[:, 1] = words, density
    rows[1:, 2], rows[1:, 3] = words[:-1], density[:-1]
    rows[:-1, 4], rows[:-1, 5] = words[1:], density[1:]
    rows[:, 6] = [b.boiler or b.outside > OUTSIDE for b in found]
    rows[:, 7] = [b.article for b in found]
    rows[:, 8] = [b.heading for b in found]
    rows[:, 9] = [b.item for b in found]
    return rows


def prose(n: int) -> str:
    """n words that stand for running text in the labelled pages."""
    return " ".join(f"word{i % 7}" for i in range(n)) + "."


def labelled_pages() -> list[tuple[str, str]]:
    """Small pages, and for each block + (content) or - (not)."""
    p = lambda *sizes: "".join(f"<p>{prose(n)}</p>" for n in sizes)
    menu = "<ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li><li><a href=/c>News and more</a></li></ul>"
    links = "".join(f"<p><a href=/{i}>{prose(6)}</a></p>" for i in range(3))
    teasers = "".join(f"<p><a href=/{i}>{prose(n)}</a></p>" for i, n in enumerate((9, 14, 30)))
    items = lambda *sizes: "".join(f"<li>{prose(n)}</li>" for n in sizes)
    return [
        *((f"<{name}>{p(*sizes)}<p><a href=x>{prose(a)}</a></p></{name}><div>{prose(b)}</div>", "+" * len(sizes) + "+-")
          for name, sizes in (("article", (1,)), ("main", (2, 9)), ("article", (5, 1, 30)), ("main", (14,)), ("article", (4,)))
          for a, b in ((1, 1), (4, 2), (9, 3))),
        *((f"<nav>{prose(1)}</nav><div><h1>{prose(a)}</h1>{p(*sizes)}</div>", "-+" + "+" * len(sizes))
          for a, sizes in ((1, (40, 7)), (2, (30, 6, 20)), (3, (40, 25, 8)), (1, (22, 40, 40, 7)))),
        *((f"<body><h1>{prose(a)}</h1>{p(b)}<ul>{items(*sizes)}</ul>{p(c)}", "+" * (3 + len(sizes)))
          for a, b, sizes, c in ((1, 30, (2, 2), 24), (2, 45, (1, 6, 3), 12), (4, 25, (8, 2), 40))),
        *((f"<article>{p(n)}</article>", "+") for n in (1, 2, 3, 8)),
        (f"<article>{p(45, 2, 9, 60, 3, 12, 120, 2, 2, 80, 1, 30, 4, 45)}</article>", "+" * 14),
        (f"<main><h1>Title</h1>{p(70, 3, 40, 1, 38, 3, 1, 250, 2, 10)}</main><div>Imprint</div>", "+" * 11 + "-"),
        (f"<article><h1>Title</h1>{p(3)}</article><footer>Us</footer>", "++-"),
        (f"<main><h1>Title</h1>{p(1, 2, 1)}</main><p>Us</p><p>Imprint</p>", "++++--"),
        (f"<article>{p(2)}<p>{prose(1)} <a href=x>{prose(1)}</a></p></article><div>Us</div>", "++-"),
        (f"<body><h1>{prose(3)}</h1>{p(30)}<ul>{items(2, 2)}</ul>{p(25)}", "+++++"),
        (f"<body><h1>{prose(3)}</h1>{p(30)}<ol>{items(5, 3, 12, 1)}</ol>", "++++++"),
        (f"<body><div>{menu}</div><h2>{prose(2)}</h2><ul>{items(1, 1, 2)}</ul>{p(28)}<div>{links}</div>", "---+++++---"),
        (f"<div>{menu}</div>{p(40)}<dl><dt>{prose(1)}</dt><dd>{prose(6)}</dd><dt>{prose(2)}</dt><dd>{prose(14)}</dd></dl><div>{teasers}</div>", "---+++++---"),
        (f"<div>{p(22)}<pre>{prose(3)}</pre>{p(35)}<blockquote>{prose(4)}</blockquote></div><div>Imprint</div>", "++++-"),
        (f"<p>{prose(25)}</p><ul><li>{prose(3)}<ul><li>{prose(2)}</li></ul></li><li>{prose(1)}</li></ul>{p(9)}<div>{menu}</div>", "+++++---"),
        (f"<div><figure><img><figcaption>{prose(5)}</figcaption></figure>{p(50, 31)}</div><div>{links}</div>", "+++---"),
        (f"<div class=sidebar><ul>{items(1, 3)}</ul></div><div><h1>{prose(4)}</h1>{p(33)}<ul>{items(9, 2)}</ul>{p(18)}</div>", "--+++++"),
        (f"<div>{p(26)}<ul>{items(2, 4)}</ul></div><div class=footer><ul>{items(1, 2)}</ul></div>", "+++--"),
        (f"<article><h1>Title</h1>{p(20)}<address>{prose(6)}</address><ul>{items(1, 1)}</ul></article><address>{prose(5)}</address>", "+++++-"),
        (f"<ol>{items(4, 2, 6)}</ol>{p(40)}<div>Log in</div><div>Search</div>", "++++--"),
        (f"<div>Menu</div><div>Skip</div><h1>{prose(2)}</h1><ul><li>{prose(30)}</li><li>{prose(2)} <a href=x>more</a></li></ul>{p(12)}", "--++++"),
        (f"<div>{teasers}</div><div><h2>{prose(3)}</h2>{p(40, 25, 12)}</div><div>{teasers}</div>", "---++++---"),
        (f"<div>{p(33, 18)}<p>{prose(14)} <a href=x>{prose(4)}</a></p></div><div>{teasers}{teasers}</div>", "+++------"),
        (f"<body><nav>{menu}</nav><article><h1>A title</h1>{p(40, 3, 90)}</article><footer>&copy; us {prose(9)}</footer>", "---++++-"),
        (f"<div class=ad>{prose(20)}</div><article><h1>{prose(9)}</h1>{p(8, 60, 1, 25)}</article><footer>{prose(25)}</footer>", "-+++++-"),
        (f"<header><p>Site</p>{menu}</header><main><h1>Title</h1><h2>Part</h2>{p(30, 5)}<ul><li>{prose(4)}</li><li>one</li></ul></main>", "----++++++"),
        (f"<article><header><h1>Title</h1></header>{p(2, 30)}<p><a href=x>See {prose(5)}</a></p>{p(14)}</article>", "+++++"),
        (f"<article>{p(50)}<aside>{prose(30)}</aside>{p(30)}<div class=comments><p>{prose(40)}</p><p>{prose(3)}</p></div></article>", "+-+--"),
        (f"<div id=cookie-notice>{prose(30)}</div><div class=header>Name</div><div>{p(60, 45, 12)}</div><div class=footer>{prose(15)}</div>", "--+++-"),
        (f"<div>{menu}</div><div><h1>{prose(5)}</h1>{p(55, 70, 9, 40)}</div><div>{links}</div>", "---+++++---"),
        (f"<table><tr><td>{menu}</td></tr><tr><td>{prose(80)}</td></tr><tr><td>{prose(60)}</td></tr></table><p>Contact</p>", "---++-"),
        (f"<div>Log in</div><div>Search</div>{p(45, 4, 38)}<div>All rights reserved</div><div>Imprint</div>", "--+++--"),
        (f"<form>{p(12)}<label>Your name</label></form><article>{p(1)}</article>{links}", "--+---"),
        (f"<main><p>{prose(20)} <a href=x>{prose(9)}</a></p><blockquote>{prose(12)}</blockquote><form>{prose(25)}</form></main>", "++-"),
        (f"<section><h1>{prose(4)}</h1><p>{prose(35)} <a href=x>more</a> {prose(9)}</p></section><div class=sidebar>{p(35)}{links}</div>", "++----"),
        (f"<div class=related>{links}</div><div class=share>Share</div><p>{prose(70)}</p><div class=newsletter>{prose(18)}</div>", "----+-"),
        (f"<article>{p(9)}{links}{p(3)}<ul><li><a href=x>one</a></li><li><a href=y>{prose(5)}</a></li></ul></article>{links}", "+++++++---"),
        (f"<nav>{menu}</nav><main>{links}{p(25)}{links}</main><div class=widget>{links}</div>", "---+++++++---"),
        (f"<article><p>one</p><p>two</p><h3>three</h3><p>four</p><nav>{menu}</nav></article><p>Terms</p><p>Privacy</p>", "++++-----"),
        (f"<div class=content-sidebar-wrap><main><h1>Title</h1>{p(40, 6, 30)}</main><div class=sidebar>{p(20)}{links}</div></div>", "++++----"),
        (f"<div class='site header-fixed'><header>{menu}</header><article><h1>Title</h1>{p(30, 4)}</article><footer>Us</footer></div>", "---+++-"),
        (f"<form><div>{menu}</div><div><h1>{prose(5)}</h1>{p(55, 8, 40)}</div></form>", "---++++"),
        (f"<div class=has-sidebar><div><h1>{prose(4)}</h1>{p(45, 60, 7, 25)}</div><div class=sidebar>{p(30)}{links}</div></div>"
         f"<div class=footer>{prose(12)}</div>", "+++++-----"),
        (f"<article>{p(40, 20)}</article><div class=related>" + f"<article><h3>{prose(5)}</h3>{p(15)}</article>" * 2 + "</div>", "++----"),
        (f"<article>{p(20)}</article><ol class=comment-list><li><article>{p(30)}</article></li></ol>", "+-"),
        (f"<form class=login>{p(2, 3, 2)}</form><div>{menu}</div><div><h2>{prose(3)}</h2>{p(30, 6)}</div>", "------+++"),
    ]


@cache
def tree():
    """The decision tree: leaves above 0 are content. Labels are coded -1 and 1, so splits lower their variance."""
    rows, labels = [], []
    for page, marks in labelled_pages():
        found = blocks(page)
        if len(found) != len(marks):
            raise ValueError(f"{len(marks)} labels for {len(found)} blocks: {[b.text for b in found]}")
        rows.append(features(found))
        labels += [1.0 if m == "+" else -1.0 for m in marks]
    labels = np.array(labels)
    return grow(np.concatenate(rows), labels, np.ones(len(labels)), depth=14, least=1, penalty=0.0)


def main_texts(pages: list[str]) -> list[str]:
    """The content blocks of each page, joined by line ends."""
    found = [blocks(page) for page in pages]
    rows = [features(x) for x in found if x]
    kept = iter(walk(tree(), np.concatenate(rows)) > 0 if rows else ())
    return ["\n".join([b.text for b in x if next(kept)]) for x in found]


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages, without their HTML, with text and n_chars (its code points).

    Null HTML is empty, and a page without content has an empty text. Malformed markup is read as far as it goes:
    what isn't a tag is text, elements that aren't closed end with what holds them. Whole pages are read, of any
    length. Equal pages have equal texts. An empty table gives no rows. Columns text and n_chars of pages are replaced.
    """
    names = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    source = fresh(pages, "source")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch[source].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*names, "text", "n_chars"])

    rows = pages.select(*names, text_of(pages[html_col]).alias(source))
    schema = pages.select(*names).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    for field in schema:
        field.nullable = True
    return rows.mapInArrow(of, schema)
