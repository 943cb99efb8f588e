"""Message metadata: sender domain, links, footer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.config import DEFAULT_CONFIG, EngineConfig
from mailloom.functions import domains, footers, links, text


def html_links(
    df: DataFrame, key: str, html: str, absolute_only: bool = True,
) -> DataFrame:
    """(key, pos, url, kind): link targets first, then media sources, first occurrence wins."""

    def tagged(urls: Column, kind: str) -> Column:
        return F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit(kind).alias("kind")))

    page = F.col(html)
    targets, media = F.array_distinct(links.hrefs(page)), F.array_distinct(links.sources(page))
    if absolute_only:
        targets, media = F.filter(targets, links.is_absolute), F.filter(media, links.is_absolute)
    both = F.concat(tagged(targets, "link"), tagged(F.array_except(media, targets), "media"))
    return df.select(key, F.posexplode(both).alias("pos", "item")).select(key, "pos", "item.*")


def resolved_links(df: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """Distinct links of each page made absolute against the address of the page."""
    found = F.array_distinct(F.transform(links.hrefs(F.col(html)), lambda h: links.resolve_url(F.col(base), h)))
    return df.select(key, F.posexplode(found).alias("pos", "url")).withColumn("host", links.url_host(F.col("url")))


def host_counts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Links per host and root domain; counted before the shuffle, so a hot host is cheap."""
    host = F.lower(links.url_host(F.col(url)))
    return (
        urls.select(host.alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("links"))
        .withColumn("root", domains.root_domain(F.col("host")))
    )


def metadata_columns(
    df: DataFrame, clean_text: str, config: EngineConfig = DEFAULT_CONFIG, footer_mode: str = "pattern",
) -> DataFrame:
    """Add sender_domain, urls and footer_text to messages that have their clean text.

    A message whose fields do not give a footer or links simply has none.
    """
    html, clean = F.col("html_content"), F.col(clean_text)
    n = config.footer_lines_count
    return df.withColumns({
        "sender_domain": domains.sender_domain(F.col("from_email")),
        "urls": links.merge_urls(
            F.when(html.contains("<"), links.html_urls(html)).otherwise(F.array().cast("array<string>")),
            links.text_urls(clean)),
        "footer_text": F.coalesce(
            footers.footer_from_html(html, n, mode=footer_mode), footers.footer_from_text(clean, n)),
    })


def clean_messages(df: DataFrame, config: EngineConfig = DEFAULT_CONFIG, mode: str = "pattern") -> DataFrame:
    """Add clean_text: cleaned body, cut at the length limit."""
    html = F.col("html_content")
    if mode == "parser":
        body = F.when(F.char_length(html) > 0, text.strip_html_parsed(html)).otherwise(
            F.coalesce("text_content", F.lit("")))
    else:
        body = text.select_body(html, F.col("text_content"))
    return df.withColumn("clean_text", text.truncate(body, config.max_email_length))


def company_details(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per (key, kind, value) of company names, addresses, phones and websites."""
    info = df.select(key, footers.company_info(F.col(column)).alias("info"))
    kinds: Sequence[tuple[str, str]] = (
        ("name", "names"), ("address", "addresses"), ("phone", "phones"), ("website", "websites"),
    )

    def tagged(kind: str, field: str) -> Column:
        return F.transform(F.col("info")[field], lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    pairs = F.concat(*[tagged(*k) for k in kinds])
    return info.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def likely_footer_counts(df: DataFrame, column: str, indicators: Sequence[str] = rules.FOOTER_INDICATORS) -> DataFrame:
    likely = footers.is_likely_footer(F.col(column), tuple(indicators))
    return df.groupBy(likely.alias("likely")).agg(F.count(F.lit(1)).alias("messages"))
