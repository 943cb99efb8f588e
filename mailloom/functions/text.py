"""Text cleaning as column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.config import DEFAULT_CONFIG

# Unicode white space plus the four separators that Python also counts as white space.
SPACE = r"(?U)[\s\x1c-\x1f]"
_SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

_INVISIBLE = (
    r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|<!--.*?(?:-->|\z)"
)
# A tag ends at the first ">" outside quotes; the second form takes tags with stray quotes.
_TAG = (
    r"""(?s)</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    r"|</?[A-Za-z][^>]*>|<![^>]*>|<\?[^>]*>"
)

#: Where truncate cuts unless told otherwise.
TRUNCATE_LIMIT = 10_000

# "&amp;" comes last so that "&amp;lt;" decodes once, to "&lt;".
_COMMON_ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)
_OTHER_ENTITY = r"&(?!(?:nbsp|lt|gt|quot|copy|middot|amp);)(?:#[0-9]|#[xX][0-9A-Fa-f]|[A-Za-z])"
_ANY_ENTITY = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?"


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def rewrite_hits(c: Column, pattern: str, rewrite) -> Column:
    """Replace each hit of ``pattern`` by ``rewrite(hit)``; built-in expressions only."""
    gaps = F.split(c, pattern, -1)
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(rewrite(hit), F.lit(""))))
    return F.concat_ws("", pieces)


def _constant_map(values: dict, key: str) -> Column:
    """A small fixed map as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>").cast(f"map<{key},string>")


def _code_point(n: Column) -> Column:
    """The character of a numeric reference, with the Windows-1252 reading of 128 to 159."""
    windows = _constant_map({i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)}, "int")
    bad = (n <= 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return (
        F.when(bad, F.lit("�"))
        .when(n.between(128, 159), F.element_at(windows, n))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _decode_one(hit: Column) -> Column:
    """One reference. A name without its semicolon, or with letters after it, still counts if it
    is one of the old names that may stand so; the longest such name wins."""
    bare = {k: v for k, v in html5.items() if not k.endswith(";")}
    names = _constant_map({k.removesuffix(";"): v for k, v in html5.items()}, "string")
    old = _constant_map(bare, "string")
    body = F.regexp_replace(hit, "^&|;$", "")
    is_hex = body.rlike("^#[xX]")
    digits = F.when(is_hex, F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(F.substr(body, F.lit(2)))
    number = F.coalesce(digits.try_cast("int"), F.lit(-1))

    def by_prefix(prefix: Column) -> Column:
        rest = F.substr(hit, F.char_length(prefix) + 2)
        return F.when(prefix != "", F.concat(F.try_element_at(old, prefix), rest)).otherwise(hit)

    longest_first = "|".join(sorted(bare, key=lambda k: (-len(k), k)))
    prefixed = bind(F.regexp_extract(body, f"^(?:{longest_first})", 0), by_prefix)
    whole = F.when(hit.endswith(";"), F.try_element_at(names, body))
    return F.when(body.startswith("#"), _code_point(number)).otherwise(F.coalesce(whole, prefixed))


def decode_entities(c: Column) -> Column:
    """Decode HTML character references. Rows without "&" and rows with only the usual few
    take a cheap way; the general way looks each reference up."""
    def decoded(t: Column) -> Column:
        usual = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), _COMMON_ENTITIES, t)
        return (
            F.when(~t.contains("&"), t)
            .when(~t.rlike(_OTHER_ENTITY), usual)
            .when(t.isNotNull(), rewrite_hits(t, _ANY_ENTITY, _decode_one))
        )

    return bind(c, decoded)


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip_whitespace(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACES))


def drop_invisible(c: Column) -> Column:
    """A document without comments, scripts and styles."""
    return F.when(c.rlike(r"(?i)<(?:script|style|!--)"), F.regexp_replace(c, _INVISIBLE, "")).otherwise(c)


def strip_tags(c: Column) -> Column:
    """Drop invisible elements and tags and decode references; white space stays as it is."""
    return decode_entities(F.regexp_replace(F.regexp_replace(c, _INVISIBLE, ""), _TAG, ""))


def strip_html(c: Column) -> Column:
    """Visible text of an HTML document on one line; "" for no document."""
    return collapse_whitespace(strip_tags(F.coalesce(c, F.lit(""))))


def strip_tags_basic(c: Column) -> Column:
    """The plain way: drop everything between angle brackets, decode nothing."""
    return collapse_whitespace(F.regexp_replace(c, "<[^>]+>", ""))


def truncate(c: Column, limit: int | None = TRUNCATE_LIMIT) -> Column:
    """Cut at ``limit`` characters and mark the cut; no limit keeps the whole text."""
    if limit is None:
        return c
    return bind(c, lambda t: F.when(
        F.char_length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t))


def select_body(html_content: Column, text_content: Column) -> Column:
    """Cleaned HTML where there is any, else the plain text, else ""."""
    return (
        F.when(F.char_length(html_content) > 0, strip_html(html_content))
        .otherwise(F.coalesce(text_content, F.lit("")))
    )


def clean_page(c: Column, min_length: int = DEFAULT_CONFIG.min_page_length) -> Column:
    """Text of a crawled page, or null where the page says too little."""
    return bind(strip_html(c), lambda t: F.when(F.char_length(t) > min_length, t))


def _tags(names: str) -> str:
    """Pattern of start and end tags of elements; ">" inside quotes ends none."""
    return rf"""(?is)</?(?:{names})(?![\w-])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?(?:{names})(?![\w-])[^>]*>"""


def elements(html: Column, names: str, wanted: Callable[[Column], Column], last: bool = True) -> Column:
    """The content of the outermost elements of these names whose start tag is ``wanted``, in order, or the last one only:
    array<struct<start, content, end>>, where start and end count pieces between tags of these names.

    One fold over the tags finds them: inside a wanted element, tags of its own name go one deeper or come back, and the
    element ends where its depth is 0 again, or with the document. An end tag without a start is passed over.
    """
    pattern = _tags(names)

    def tag(t: Column, i: Column) -> Column:
        closing = t.startswith("</")
        return F.struct(
            i.cast("int").alias("at"), F.lower(F.regexp_extract(t, "^</?([A-Za-z]+)", 1)).alias("name"), closing.alias("closing"),
            t.endswith("/>").alias("single"), (~closing & wanted(t)).alias("wanted"))

    def step(acc: Column, x: Column) -> Column:
        outside = acc["depth"] == 0
        opens = outside & x["wanted"] & ~x["single"]
        same = ~outside & (x["name"] == acc["name"])
        depth = (
            F.when(opens, F.lit(1)).when(same & x["closing"], acc["depth"] - 1)
            .when(same & ~x["single"], acc["depth"] + 1).otherwise(acc["depth"]))
        closed = ~outside & (depth == 0)
        span = F.array(F.struct(acc["start"].alias("start"), x["at"].alias("end")))
        found = F.when(closed, span if last else F.concat(acc["found"], span)).otherwise(acc["found"])
        return F.struct(
            depth.alias("depth"), F.when(opens, x["name"]).otherwise(acc["name"]).alias("name"),
            F.when(opens, x["at"]).otherwise(acc["start"]).alias("start"), found.alias("found"))

    kind = "array<struct<start:int,end:int>>"
    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("name"), F.lit(0).alias("start"), F.array().cast(kind).alias("found"))

    def finish(acc: Column, count: Column) -> Column:
        rest = F.array(F.struct(acc["start"].alias("start"), count.alias("end")))
        return F.when(acc["depth"] > 0, rest if last else F.concat(acc["found"], rest)).otherwise(acc["found"])

    def of(page: Column) -> Column:
        pieces = F.split(page, pattern, -1)
        tags = F.transform(F.regexp_extract_all(page, F.lit(pattern), F.lit(0)), tag)
        spans = bind(tags, lambda t: bind(F.aggregate(t, begin, step), lambda acc: finish(acc, F.size(t))))
        return bind(pieces, lambda x: bind(spans, lambda s: F.transform(s, lambda e: F.struct(
            e["start"].alias("start"),
            F.concat_ws("", F.slice(x, e["start"] + 2, e["end"] - e["start"])).alias("content"), e["end"].alias("end")))))

    return bind(html, of)


def without_elements(html: Column, names: str) -> Column:
    """A document without the outermost elements of these names."""
    def cut(page: Column) -> Column:
        pieces = F.split(page, _tags(names), -1)
        inside = elements(page, names, lambda t: F.lit(True), last=False)
        return bind(pieces, lambda x: bind(inside, lambda s: F.concat_ws("", F.concat(
            F.array(F.concat_ws("", F.slice(x, F.lit(1), F.coalesce(F.get(s, F.lit(0))["start"], F.size(x) - 1) + 1))),
            F.transform(s, lambda e, i: F.concat_ws("", F.slice(
                x, e["end"] + 2, F.greatest(F.lit(0), F.coalesce(F.get(s, i + 1)["start"], F.size(x) - 1) - e["end"]))))))))

    return bind(html, lambda page: F.when(page.rlike(f"(?i)<(?:{names})"), cut(page)).otherwise(page))


def strip_html_parsed(c: Column) -> Column:
    """``strip_html`` without the content of templates, nested ones too, which no browser shows."""
    return strip_html(without_elements(drop_invisible(F.coalesce(c, F.lit(""))), "template"))
