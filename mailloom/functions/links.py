"""Links and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.functions.text import bind, decode_entities, drop_invisible, strip_whitespace

_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
_HREF = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*" + _VALUE
_SRC = r"(?is)<(?:img|iframe|embed)\s(?:[^>]*?\s)?src\s*=\s*" + _VALUE
_ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)[^>]*>.*?(?:</a\s*>|\z)"


def _unquote(c: Column) -> Column:
    return decode_entities(F.regexp_replace(c, r"""^["']|["']$""", ""))


def _attribute_values(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), _unquote)


def hrefs(html: Column) -> Column:
    return _attribute_values(html, _HREF)


def sources(html: Column) -> Column:
    return _attribute_values(html, _SRC)


def is_absolute(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def html_urls(html: Column) -> Column:
    """Absolute link targets, then absolute media sources; first occurrence wins."""
    def found(shown: Column) -> Column:
        both = F.concat(F.filter(hrefs(shown), is_absolute), F.filter(sources(shown), is_absolute))
        return F.array_distinct(F.coalesce(both, F.array().cast("array<string>")))

    return bind(drop_invisible(html), found)


def anchors(html: Column) -> Column:
    """array<struct<href, label>> of the links of a page, in order."""
    hits = F.regexp_extract_all(drop_invisible(html), F.lit(_ANCHOR), F.lit(0))
    return F.transform(hits, lambda a: F.struct(
        _unquote(F.regexp_extract(a, _HREF, 1)).alias("href"),
        F.regexp_replace(F.regexp_replace(a, r"<[^>]+>", ""), r"\s+", " ").alias("label"),
    ))


def url_host(url: Column) -> Column:
    """Network part of a URL: host with port and user where given, "" without one."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def _parses(url: Column) -> Column:
    host = url_host(url)
    return (host != "") & (host.contains("[") == host.contains("]"))


def text_urls(text: Column, validate: bool = True) -> Column:
    """URLs in plain text. Unvalidated, the scheme must be lower case and repeats are dropped."""
    pattern = "(?U)" + rules.TEXT_URL
    if not validate:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = F.filter(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0)), _parses)
    return (
        F.when(F.coalesce(F.ilike(text, F.lit("%http%")), F.lit(False)), found)
        .otherwise(F.array().cast("array<string>"))
    )


def merge_urls(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def url_hosts(urls: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(urls, url_host), lambda h: h != ""))


def _without_dots(path: Column) -> Column:
    """Remove "." and ".." segments from an absolute path."""
    return bind(path, _walk)


def _walk(path: Column) -> Column:
    segments = F.split(path, "/")
    walked = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    ends_in_dot = F.element_at(segments, -1).isin(".", "..")
    joined = F.array_join(walked, "/")
    joined = F.when(ends_in_dot & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.contains("/."), joined).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Make a link absolute against the address of the page it stands on."""
    href = strip_whitespace(href)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(site, base_path, href))
        .otherwise(F.concat(site, _without_dots(rooted), rest))
    )


def normalise_url(url: Column) -> Column:
    """Join key of a page: lower-case scheme and host, no fragment, no slash at the end."""
    bare = F.regexp_replace(url, r"#.*$", "")
    site = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.substr(bare, F.char_length(site) + 1)
    return F.concat(F.lower(site), F.regexp_replace(rest, r"/$", ""))


def site_url(site: Column) -> Column:
    """Give a site a scheme if it has none."""
    return F.when(is_absolute(site), site).otherwise(F.concat(F.lit("https://"), site))
