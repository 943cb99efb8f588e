"""Footers and company details as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.config import DEFAULT_CONFIG
from mailloom.functions import text as tx
from mailloom.functions.links import text_urls


def is_likely_footer(c: Column, indicators: tuple[str, ...] = rules.FOOTER_INDICATORS) -> Column:
    """At least two indicator words, or an address, or a link."""

    def likely(lower: Column) -> Column:
        hits = sum((lower.contains(word).cast("int") for word in indicators), F.lit(0))
        return lower.contains("@") | lower.contains("http") | (hits >= 2)

    return tx.bind(F.lower(c), likely)


def last_lines(c: Column, count: int = DEFAULT_CONFIG.footer_lines_count) -> Column:
    """The last non-empty lines, trimmed; null where there are fewer than asked for."""

    def tail(part: Column) -> Column:
        packed = tx.strip_whitespace(F.regexp_replace(part, rf"{tx.SPACE}*\n{tx.SPACE}*", "\n"))

        def take(lines: Column) -> Column:
            breaks = F.char_length(lines) - F.char_length(F.replace(lines, F.lit("\n"), F.lit("")))
            return F.when((lines != "") & (breaks >= count - 1), F.substring_index(lines, "\n", -count))

        return tx.bind(packed, take)

    # Two more lines than asked for mostly do; only if blank lines leave too few, read the whole text.
    return F.coalesce(tail(F.substring_index(c, "\n", -(count + 2))), tail(c))


def footer_from_text(
    c: Column,
    count: int = DEFAULT_CONFIG.footer_lines_count,
    indicators: tuple[str, ...] = rules.FOOTER_INDICATORS,
) -> Column:
    return tx.bind(last_lines(c, count), lambda lines: F.when(is_likely_footer(lines, indicators), lines))


def footer_from_html(
    c: Column,
    count: int = DEFAULT_CONFIG.footer_lines_count,
    classes: tuple[str, ...] = rules.FOOTER_CLASSES,
    strict: bool = False,
    mode: str = "pattern",
) -> Column:
    """Text of the last outermost footer-like element, with all that is nested in it.

    Footer-like is a ``footer`` or ``div`` whose class names one of ``classes`` and, unless
    ``strict``, any ``footer``. ``mode="parser"`` leaves templates out.
    """
    names = "|".join(classes)
    classed = (
        r"(?is)^<(?:footer|div)\b.*?\sclass\s*=\s*"
        rf"""(?:"[^"]*(?:{names})[^"]*"|'[^']*(?:{names})[^']*'|[^\s"'>]*(?:{names})[^\s"'>]*)"""
    )
    shown = tx.drop_invisible(c)
    if mode == "parser":
        shown = tx.without_elements(shown, "template")

    def footer_like(tag: Column) -> Column:
        named = tag.rlike(classed)
        return named if strict else named | tag.rlike("(?i)^<footer")

    may = F.lower(shown).rlike(f"<footer|{names}") if classes else F.lower(shown).contains("<footer")
    last = F.when(may, F.try_element_at(tx.elements(shown, "div|footer", footer_like), F.lit(-1))["content"])
    found = tx.collapse_whitespace(tx.strip_tags(last))
    # Cleaned HTML is one line, so the last-lines rule can apply only when one line is enough.
    shown = tx.bind(found, lambda f: F.when(f != "", f))
    if count > 1:
        return shown
    return F.coalesce(shown, tx.bind(tx.strip_html(c), lambda w: F.when(w != "", w)))


def _distinct_hits(c: Column, pattern: str, gate: str) -> Column:
    hits = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    return F.when(c.rlike(gate), hits).otherwise(F.array().cast("array<string>"))


def company_names(c: Column) -> Column:
    return _distinct_hits(c, "(?U)" + rules.COMPANY_NAME, "Inc|LLC|Corp|Company|Ltd|Limited")


def addresses(c: Column) -> Column:
    return _distinct_hits(c, "(?iU)" + rules.STREET_ADDRESS, r"(?U)\d\s+[A-Za-z,]")


def company_phones(c: Column) -> Column:
    return _distinct_hits(c, "(?U)" + rules.COMPANY_PHONE, "[0-9]{4}")


def company_info(c: Column) -> Column:
    return F.struct(
        company_names(c).alias("names"),
        addresses(c).alias("addresses"),
        company_phones(c).alias("phones"),
        text_urls(c).alias("websites"),
    )
