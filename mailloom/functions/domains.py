"""Addresses and domains as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.config import DEFAULT_CONFIG, EngineConfig
from mailloom.functions.text import strip_whitespace


def is_valid_email(c: Column) -> Column:
    value = F.coalesce(c, F.lit(""))
    return (F.lower(value) != "none") & strip_whitespace(value).rlike(rules.VALID_EMAIL)


def sender_domain(c: Column) -> Column:
    return F.coalesce(F.lower(F.try_element_at(F.split(c, "@"), F.lit(2))), F.lit("unknown"))


def root_domain(c: Column) -> Column:
    """Last two labels; a single label stays as it is."""
    return F.substring_index(c, ".", -2)


def domains_similar(a: Column, b: Column, prefixes: tuple[str, ...] = rules.MAIL_PREFIXES) -> Column:
    """Same root, or one below the other, or one is the other behind a mail prefix."""
    dot = F.lit(".")
    similar = root_domain(a) == root_domain(b)
    similar = similar | F.endswith(a, F.concat(dot, b)) | F.endswith(b, F.concat(dot, a))
    for p in prefixes:
        head = F.lit(f"{p}.")
        similar = similar | (a == F.concat(head, b)) | (b == F.concat(head, a))
    return similar


def domain_weight(query: Column, candidate: Column, config: EngineConfig = DEFAULT_CONFIG) -> Column:
    missing = (F.coalesce(query, F.lit("")) == "") | (F.coalesce(candidate, F.lit("")) == "")
    q, c = strip_whitespace(F.lower(query)), strip_whitespace(F.lower(candidate))
    return (
        F.when(missing, F.lit(config.default_domain_weight))
        .when(q == c, F.lit(config.exact_domain_weight))
        .when(domains_similar(q, c), F.lit(config.similar_domain_weight))
        .otherwise(F.lit(config.default_domain_weight))
    )


def company_from_domain(c: Column) -> Column:
    """Second-last label with a capital first letter."""
    label = F.try_element_at(F.split(c, r"\."), F.lit(-2))
    named = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substr(label, F.lit(2))))
    return F.coalesce(named, F.lit("Unknown Company"))
