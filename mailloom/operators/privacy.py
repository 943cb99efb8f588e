"""Data-protection contacts, found by joining sites to a table of crawled pages.

Pages are read once: links and addresses are taken from each page where it lies, and only those few short rows meet the
sites. Candidates are tried in waves, and a site that has an address isn't in the next one. The usual places depend on a
site's host alone and the found links on its first page alone, so hosts and first pages are resolved, each once, however
many sites share them. Texts move only where a model reads them, and then only those of pages that a wave asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.config import DEFAULT_CONFIG
from mailloom.functions import domains, links, text
from mailloom.operators.classify import call_model
from mailloom.operators.skew import cut_lineage, lookup_join
from mailloom.rules import FOUND_EMAIL, DpoWords

NOT_FOUND = "No DPO email found in privacy policies"
NO_URLS = "No privacy policy URLs found"


def dpo_email(c: Column, words: DpoWords = DpoWords()) -> Column:
    """The first address by the first pattern that gives one.

    A pattern that starts with an address is tried only where a run of its characters starts: a match from there is
    the leftmost, and a long run without one takes linear time.
    """
    start = f"(?i)({FOUND_EMAIL})"
    patterns = [
        p.replace(start, f"(?i)(?<![a-zA-Z0-9._%+-])({FOUND_EMAIL})", 1) if p.startswith(start) else p
        for p in words.patterns()
    ]

    def first(t: Column) -> Column:
        tries = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns]
        return F.when(t.contains("@"), F.coalesce(*tries))

    return text.bind(c, first)


def host_part(url: Column) -> Column:
    """Scheme and host of an absolute address."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def usual_places(host: Column, paths: Sequence[str]) -> Column:
    return F.array(*[F.concat(host, F.lit(p)) for p in paths]).cast("array<string>")


def privacy_url_candidates(
    sites: DataFrame, site: str, found_links: DataFrame | None = None,
    paths: Sequence[str] = rules.PRIVACY_PATHS,
) -> DataFrame:
    """(site, url, pos): the usual places in order, then links found on the site's first page.

    ``found_links`` has (page_url, url, pos), as given by ``privacy_links``.
    """
    base = links.site_url(F.col(site))
    usual = sites.select(site, F.posexplode(usual_places(host_part(base), paths)).alias("pos", "url"))
    if found_links is None:
        return usual.select(site, "url", "pos")
    keyed = sites.select(site, links.normalise_url(base).alias("_page"))
    # A page may have any number of copies; its links are merged before they meet the sites.
    from_page = (
        found_links.select(links.normalise_url(F.col("page_url")).alias("_page"), "url", "pos")
        .groupBy("_page", "url").agg((F.min("pos") + len(paths)).alias("pos"))
    )
    both = usual.select(site, "url", "pos").unionByName(
        keyed.join(from_page, "_page").select(site, "url", "pos"))
    return both.groupBy(site, "url").agg(F.min("pos").alias("pos"))


def privacy_urls(
    url: Column, html: Column,
    href_words: Sequence[str] = rules.PRIVACY_HREF_WORDS,
    text_words: Sequence[str] = rules.PRIVACY_TEXT_WORDS,
) -> Column:
    """Links of a page that speak of privacy, made absolute, best kind first."""

    def kind(link: Column) -> Column:
        label = F.lower(link["label"])
        tests = [link["href"].contains(w) for w in href_words] + [label.contains(w) for w in text_words]
        return F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)], F.lit(-1))

    found = F.filter(links.anchors(html), lambda a: (a["href"] != "") & (kind(a) >= 0))
    ranked = F.array_sort(F.transform(found, lambda a, i: F.struct(
        kind(a).alias("kind"), i.alias("at"), links.resolve_url(url, a["href"]).alias("url"))))
    return F.array_distinct(F.transform(ranked, lambda r: r["url"]))


def privacy_links(
    pages: DataFrame, url: str, html: str,
    href_words: Sequence[str] = rules.PRIVACY_HREF_WORDS,
    text_words: Sequence[str] = rules.PRIVACY_TEXT_WORDS,
) -> DataFrame:
    """(page_url, url, pos): the ``privacy_urls`` of each page."""
    urls = privacy_urls(F.col(url), F.col(html), href_words, text_words)
    linking = pages.where(F.col(html).contains("<"))
    return linking.select(F.col(url).alias("page_url"), F.posexplode(urls).alias("pos", "url")).select("page_url", "url", "pos")


def may_have_address(html: Column) -> Column:
    return html.contains("@") | html.contains("&#") | html.contains("&commat;")


def first_contacts(rows: DataFrame, contact: Column) -> DataFrame:
    """(page_key, contact): of the copies of a page, the first by _id that has an address counts."""
    # Exploding the found address, rather than filtering on it, works it out only once.
    found = F.explode(F.filter(F.array(contact), lambda x: x.isNotNull())).alias("contact")
    return (
        rows.select("page_key", "_id", found)
        .groupBy("page_key").agg(F.min_by("contact", "_id").alias("contact"))
    )


def asked_contacts(
    rows: DataFrame, model: Callable[[pd.Series], pd.Series], kept: str | None, fallback: Column,
) -> DataFrame:
    """``first_contacts`` of rows (page_key, _id, _text) by the model; where it gives no address, by ``fallback``."""
    asked = rows.where(F.col("_text").isNotNull()).withColumn("_ask", F.concat(
        F.lit("Give the e-mail address of the data protection officer named in this text, or None.\n\n"),
        text.truncate(F.col("_text"), DEFAULT_CONFIG.max_policy_length)))
    reply = text.strip_whitespace(F.col("_reply"))
    replied = call_model(asked, "_ask", "_reply", model, kept)
    return first_contacts(replied, F.coalesce(F.when(domains.is_valid_email(reply), reply), fallback))


def page_contacts(
    pages: DataFrame, page_id: str, url: str, html: str, words: DpoWords = DpoWords(),
    limit: int | None = None, min_length: int = 0, model: Callable[[pd.Series], pd.Series] | None = None,
    kept: str | None = None,
) -> DataFrame:
    """(page_key, contact): one data-protection address per page address.

    Of several copies of a page the first by id that has an address counts. With ``model`` the
    model is asked first, on at most the configured length; the patterns are the fallback.
    """
    content = text.clean_page(F.col(html), min_length)
    if limit is not None:
        content = text.truncate(content, limit)
    rows = (pages if model else pages.where(may_have_address(F.col(html)))).select(
        links.normalise_url(F.col(url)).alias("page_key"), F.col(page_id).alias("_id"), content.alias("_text"))
    contact = dpo_email(F.col("_text"), words)
    return asked_contacts(rows, model, kept, contact) if model else first_contacts(rows, contact)


def page_facts(
    pages: DataFrame, page_id: str, url: str, html: str, words: DpoWords = DpoWords(), with_text: bool = False,
    href_words: Sequence[str] = rules.PRIVACY_HREF_WORDS, text_words: Sequence[str] = rules.PRIVACY_TEXT_WORDS,
) -> DataFrame:
    """(page_key, _id, contact, links and, if asked for, _text): what resolution needs of a page, in one pass.

    Pages that say nothing are left out. The table is stored, so that readers get the columns they need.
    """
    html = F.col(html)
    found = F.when(html.contains("<"), privacy_urls(F.col(url), html, href_words, text_words))

    def of(content: Column) -> Column:
        contact = F.when(may_have_address(html), dpo_email(content, words))
        facts = [contact.alias("contact"), found.alias("links")]
        return F.struct(*facts, *([content.alias("_text")] if with_text else []))

    def speaks(fact: Column) -> Column:
        some = fact["contact"].isNotNull() | (F.coalesce(F.size(fact["links"]), F.lit(0)) > 0)
        return some | fact["_text"].isNotNull() if with_text else some

    # Without a model, only pages that may have an address are cleaned.
    content = text.clean_page(html, 0)
    fact = text.bind(content, of) if with_text else of(content)
    # Exploding, rather than filtering, works the facts out only once.
    facts = F.explode(F.filter(F.array(fact), speaks)).alias("_fact")
    return cut_lineage(pages.select(
        links.normalise_url(F.col(url)).alias("page_key"), F.col(page_id).alias("_id"), facts,
    ).select("page_key", "_id", "_fact.*"))


def resolve_site_policy(candidates: DataFrame, contacts: DataFrame, site: str) -> DataFrame:
    """One row per site: the first candidate page with an address, or the reason there is none."""
    keyed = candidates.withColumn("page_key", links.normalise_url(F.col("url")))
    # Few bytes per row; where many sites share one page, adaptive execution splits that key.
    met = first_found(keyed.join(contacts, "page_key", "left"), site)
    return met.select(site, *outcome(F.col("_hit")), F.when(F.col("_hit").isNull(), F.lit(NOT_FOUND)).alias("error_message"))


def first_found(met: DataFrame, key: str) -> DataFrame:
    """Candidates (key, url, pos, contact) -> (key, _hit): contact and url of the first that has a contact, or null."""
    hit = F.struct(F.col("contact"), F.col("url"))
    first = F.min_by(hit, F.when(F.col("contact").isNotNull(), F.struct("pos", "url")))
    return met.groupBy(key).agg(first.alias("_hit"))


def outcome(hit: Column) -> list[Column]:
    return [hit["contact"].alias("dpo_email"), hit["url"].alias("privacy_policy_url"), hit.isNotNull().alias("success")]


def waves(paths: Sequence[str], asks: bool) -> list[list[tuple[int, str]]]:
    """(pos, path) of each wave. What nobody is asked for costs next to nothing, so there is one wave of it. A model's
    answers do cost, so its waves have one place, then two, four and so on."""
    placed, found = list(enumerate(paths)), []
    while placed:
        size = 2 ** len(found) if asks else len(placed)
        found.append(placed[:size])
        placed = placed[size:]
    return found


def site_policies(
    sites: DataFrame, site: str, pages: DataFrame, page_id: str, url: str, html: str,
    words: DpoWords = DpoWords(), paths: Sequence[str] = rules.PRIVACY_PATHS,
    model: Callable[[pd.Series], pd.Series] | None = None, kept: str | None = None,
    href_words: Sequence[str] = rules.PRIVACY_HREF_WORDS, text_words: Sequence[str] = rules.PRIVACY_TEXT_WORDS,
) -> DataFrame:
    """One row per distinct site: its address and where it stands, or the reason there is none.

    The usual places come first, in order, then the links of the site's first page, for sites that have nothing by then.
    Of links that copies of a first page rank alike, the least address counts.
    """
    base = links.site_url(F.col(site))
    known = cut_lineage(sites.select(site).where(F.col(site).isNotNull()).distinct().select(
        site, host_part(base).alias("_host"), links.normalise_url(base).alias("_first")))
    facts = page_facts(pages, page_id, url, html, words, model is not None, href_words, text_words)

    def contacts_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
        """(page_key, contact) of the rows of facts; a model reads only pages among those asked for."""
        if model is None:
            return first_contacts(rows, F.col("contact"))
        wanted = asked.select("page_key").distinct().withColumn("_wanted", F.lit(True))
        return asked_contacts(
            lookup_join(rows, wanted, "page_key").where("_wanted").drop("_wanted"), model, kept, F.col("contact"))

    left, found = known.select("_host").distinct(), []
    for wave in waves(paths, model is not None):
        places = F.array(*[F.struct(F.lit(pos).alias("pos"), F.concat("_host", F.lit(p)).alias("url")) for pos, p in wave])
        tried = left.select("_host", F.explode(places).alias("_at")).select(
            "_host", "_at.*", links.normalise_url(F.col("_at.url")).alias("page_key"))
        # Pages elsewhere are left out before anything moves.
        rest = F.substr("page_key", F.char_length(host_part(F.col("page_key"))) + 1)
        there = facts.where(rest.isin(*{p.partition("#")[0].removesuffix("/") for _, p in wave}))
        met = tried.join(contacts_of(there, tried), "page_key")
        found.append(cut_lineage(first_found(met, "_host").where("_hit is not null")))
        left = left.join(found[-1], "_host", "left_anti")
    usual = known.select("_host").limit(0).withColumn("_hit", F.lit(None).cast("struct<contact:string,url:string>"))
    for wave_found in found:
        usual = usual.unionByName(wave_found)

    # A page may have any number of copies; its links are merged before they meet the sites.
    open_ = known.join(left, "_host", "left_semi").select(F.col("_first").alias("page_key")).distinct()
    linked = (
        facts.select("page_key", F.posexplode("links").alias("pos", "url")).groupBy("page_key", "url").agg(F.min("pos").alias("pos"))
        .join(open_, "page_key", "left_semi")
        .select(F.col("page_key").alias("_first"), "url", "pos", links.normalise_url(F.col("url")).alias("page_key")))
    linked = cut_lineage(linked)
    by_link = first_found(lookup_join(linked, contacts_of(facts, linked), "page_key"), "_first")
    by_link = by_link.select("_first", F.col("_hit").alias("_link_hit"), F.lit(True).alias("_linked"))

    met = lookup_join(lookup_join(known, usual, "_host"), by_link, "_first")
    hit = F.coalesce("_hit", "_link_hit")
    tried_any = F.lit(True) if paths else F.coalesce("_linked", F.lit(False))
    reason = F.when(hit.isNull(), F.when(tried_any, F.lit(NOT_FOUND)).otherwise(F.lit(NO_URLS)))
    return met.select(site, *outcome(hit), reason.alias("error_message"))


def enrich_dpo(messages: DataFrame, policies: DataFrame, website: str, dpo: str, site: str) -> DataFrame:
    """Fill in missing addresses of organisations with a website; other rows stay as they are."""
    missing = (F.coalesce(dpo, F.lit("")) == "") & (F.coalesce(website, F.lit("")) != "")
    known = policies.where("success").select(F.col(site).alias("_site"), F.col("dpo_email").alias("_found"))
    keyed = messages.withColumn("_site", F.when(missing, F.col(website)))
    joined = lookup_join(keyed, cut_lineage(known), "_site")
    return joined.withColumn(dpo, F.coalesce("_found", dpo)).drop("_site", "_found").select(*messages.columns)
