import html
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from mailloom.functions import domains, footers, links, text


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r["x"] for r in df.select("i", make(F.col("c")).alias("x")).orderBy("i").collect()]


ENTITY_ROWS = [
    "a &amp;lt; b", "x&nbsp;y &#39;q&#39; &#x2014; &hellip; &copy;", "AT&T &#150; &#128512; &bogus;",
    "&#0; &#xD800; &#99999999999;", "no entity", "", "&amp;amp; &quot;q&quot;",
    "a&ampb &ampÄ &notit; &notin; &copy2 &LT &rsquo &rsquo; &ampfoo; &eacutex;",
]


def test_entities_decode_as_python_does(spark):
    rows = [r for r in ENTITY_ROWS if "99999999999" not in r]
    assert values(spark, rows, text.decode_entities) == [html.unescape(r) for r in rows]


HTML_ROWS = [
    (None, ""), ("", ""), ("<script>var a='</p>'</script>t<!-- c > d -->u<b>v</b>", "tuv"),
    ("<p title='a>b'>hi</p>", "hi"), ("<p>one</p><p>two</p>", "onetwo"), ("a&nbsp; b\n\tc", "a b c"),
    ("a < b and c > d", "a < b and c > d"), ("<style>p{}", ""), ("x&amp;lt;y", "x&lt;y"),
    ("café x\x1c\n y", "café x y"),
]


@pytest.mark.parametrize("mode", ["pattern", "parser"])
def test_strip_html(spark, mode):
    make = text.strip_html if mode == "pattern" else text.strip_html_parsed
    assert values(spark, [h for h, _ in HTML_ROWS], make) == [t for _, t in HTML_ROWS]


def test_stray_quote_still_ends_a_tag(spark):
    assert values(spark, ["<a title=it's>x</a> y"], text.strip_html) == ["x y"]


def test_truncate_at_the_limit(spark):
    out = values(spark, ["a" * n for n in (9_999, 10_000, 10_001)], text.truncate)
    assert [len(x) for x in out] == [9_999, 10_000, 10_003]
    assert out[2].endswith("a...")
    assert values(spark, ["a" * 20_000], lambda c: text.truncate(c, None)) == ["a" * 20_000]


def test_clean_page_needs_more_than_100_chars(spark):
    assert values(spark, ["x" * 100, "x" * 101], text.clean_page) == [None, "x" * 101]


def test_select_body(spark):
    df = spark.createDataFrame([("<b>h</b>", "t"), ("", "t"), (None, None)], "h string, t string")
    got = [r[0] for r in df.select(text.select_body(F.col("h"), F.col("t"))).collect()]
    assert got == ["h", "t", ""]


def test_sender_domain(spark):
    rows = ["a@B.com", "a", "a@b@c", None, "a@"]
    assert values(spark, rows, domains.sender_domain) == ["b.com", "unknown", "b", "unknown", ""]


def test_valid_email(spark):
    rows = ["a.b@c.io", " a@b.co ", "none", "None", "", None, "a@b", "a@b.c1", "a b@c.io"]
    assert values(spark, rows, domains.is_valid_email) == [True, True] + [False] * 7


@pytest.mark.parametrize(("a", "b", "weight"), [
    ("x.com", "x.com", 1.0), (" X.com", "x.com ", 1.0), ("mail.x.com", "x.com", 0.8), ("a.co.uk", "b.co.uk", 0.8),
    ("x", "a.x", 0.8), ("noreply.x", "x", 0.8), ("a.com", "b.com", 0.5), ("", "x.com", 0.5), (None, "x.com", 0.5),
])
def test_domain_weight(spark, a, b, weight):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(domains.domain_weight(F.col("a"), F.col("b"))).first()
    assert row[0] == weight


def test_company_from_domain(spark):
    rows = ["mail.SHOP.com", "x.com", "localhost"]
    assert values(spark, rows, domains.company_from_domain) == ["Shop", "X", "Unknown Company"]


PAGE = (
    '<html><a href="https://a.com/x?a=1&amp;b=2">q</a><a class=y href=\'http://b.com\'>Privacy <b>Policy</b></a>'
    '<img src="https://i.com/1.png"><a href="/rel">z</a><a href="https://a.com/x?a=1&amp;b=2">q</a>'
    '<div class="x Footer-Main">one</div><footer>two <p>three</p></footer></html>'
)


def test_html_urls_keep_order_and_drop_repeats(spark):
    assert values(spark, [PAGE, None], links.html_urls) == [
        ["https://a.com/x?a=1&b=2", "http://b.com", "https://i.com/1.png"], []]


def test_text_urls(spark):
    rows = ["see HTTP://A.com/x., https://b.org/y) https:// http://[abc x https://b.org/y", "", None, "none"]
    assert values(spark, rows, links.text_urls) == [
        ["HTTP://A.com/x", "https://b.org/y", "https://b.org/y"], [], [], []]
    plain = values(spark, rows[:1], lambda c: links.text_urls(c, validate=False))
    assert plain == [["https://b.org/y", "http://[abc"]]


URLS = [
    ("https://x.com/a/b.html?q=1#f", "../c"), ("https://x.com/a/b", "d?x=1"), ("https://x.com", "p"),
    ("https://x.com/a/", "//h.com/z"), ("https://x.com/a", "/r/./s/../t"), ("https://x.com/a?b", "#k"),
    ("https://x.com/a?b", "?k"), ("https://x.com/a", "mailto:a@b.c"), ("http://x.com/a/b/c", "../../../../g/.."),
    ("http://x.com/a", "https://y.org/q"),
]


def test_relative_links_resolve_as_python_does(spark):
    df = spark.createDataFrame(URLS, "b string, h string")
    for r in df.select("b", "h", links.resolve_url(F.col("b"), F.col("h")).alias("u")).collect():
        assert r.u == urljoin(r.b, r.h)


@pytest.mark.parametrize("mode", ["pattern", "parser"])
def test_footer_from_html(spark, mode):
    rows = [PAGE, None, "<p>none</p>", "<footer>a</footer><footer>b &amp; c</footer>", "<footer> </footer>"]
    assert values(spark, rows, lambda c: footers.footer_from_html(c, mode=mode)) == ["two three", None, None, "b & c", None]
    strict = values(spark, rows[:1], lambda c: footers.footer_from_html(c, strict=True, mode=mode))
    assert strict == ["one"]


@pytest.mark.parametrize("mode", ["pattern", "parser"])
def test_nested_footers_are_whole(spark, mode):
    pages = [
        '<div class="footer">a <div>b</div> c</div>', '<div class="footer">a <div class=bottom>b</div> c</div> d',
        '<footer>a<footer>b</footer>c</footer>d', '</div><div class=signature>a<div><div>b</div></div>c</div><div>d</div>',
        '<div class=footer>a<div/>b</div>c', '<div class=footer>a<br>b', '<DIV title="a>b" class="x bottom">a</DIV >b',
        '<div class=footer>' + '<div>x ' * 500 + '</div>' * 500 + 'y</div> z',
        '<div class=footer>a <footer>b</div> c</footer>', '<divider class=footer>a</divider>', '<!-- <footer>a</footer> -->b']
    assert values(spark, pages, lambda c: footers.footer_from_html(c, mode=mode)) == [
        "a b c", "a b c", "abc", "abc", "ab", "ab", "a", ("x " * 500 + "y"), "a b", None, None]


def test_templates_are_hidden(spark):
    pages = ["a<template>b<template>c</template>d</template>e<TEMPLATE x='>'>f</template>g", "<template>a", "</template>a<p>b",
             "no <b>tags</b> here", None, "<template/>a"]
    assert values(spark, pages, text.strip_html_parsed) == ["aeg", "", "ab", "no tags here", "", "a"]
    assert values(spark, ["x<template><footer>a</footer></template><footer>b</footer><template><footer>c</footer></template>"],
                  lambda c: footers.footer_from_html(c, mode="parser")) == ["b"]


def test_many_tags_of_one_page(spark):
    page = "<div>x</div>" * 20_000 + "<div class=footer>the <div>end</div></div>"
    assert values(spark, [page], footers.footer_from_html) == ["the end"]


def test_last_lines(spark):
    rows = ["a\n\n b \nc@\n", "a\nb", "\n x\r\n\ty\nz\nq", "a\nb\nc" + "\n" * 30, None, ""]
    assert values(spark, rows, footers.last_lines) == ["a\nb\nc@", None, "y\nz\nq", "a\nb\nc", None, None]


def test_likely_footer(spark):
    rows = ["Unsubscribe | Company", "email only", "x@y", "HTTP://z", "plain", "© phone"]
    assert values(spark, rows, footers.is_likely_footer) == [True, False, True, True, False, True]


def test_company_info(spark):
    body = "Made by Acme Widgets Inc. at 150 Elgin Street, call +1-555-123-4567 or (206) 266-1000, https://acme.com/a."
    info = values(spark, [body], footers.company_info)[0]
    assert info["names"] == ["Made by Acme Widgets Inc"]
    assert info["addresses"] == ["150 Elgin Street"]
    assert info["phones"] == ["+1-555-123-4567", "(206) 266-1000"]
    assert info["websites"] == ["https://acme.com/a"]
