"""Jobs: whole tables in, whole tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.config import DEFAULT_CONFIG, EngineConfig
from mailloom.operators import ingest, metadata, pii, privacy, reports, store
from mailloom.sources import messages as source


def ingest_folder(spark: SparkSession, path: str, required=rules.REQUIRED_KEYS) -> dict[str, DataFrame]:
    """Messages with their expected labels, quarantine and report of a folder of files."""
    checked = ingest.with_problem(source.raw_messages(spark, path), required=required)
    good, bad = ingest.split_failures(checked)
    return {
        "messages": source.label_from_filename(source.message_id(ingest.parse_messages(good))),
        "quarantine": bad,
        "status": ingest.item_status(checked, "source_file"),
        "report": ingest.ingest_report(checked),
    }


def clean_corpus(messages: DataFrame, config: EngineConfig = DEFAULT_CONFIG, mode: str = "pattern") -> DataFrame:
    return metadata.clean_messages(messages, config, mode).select("email_id", "clean_text")


def link_table(pages: DataFrame, key: str, html: str, base: str) -> dict[str, DataFrame]:
    links = metadata.resolved_links(pages, key, html, base)
    hosts = metadata.host_counts(links)
    return {
        "links": links, "hosts": hosts,
        "roots": hosts.groupBy("root").agg(F.sum("links").alias("links")),
    }


def metadata_table(messages: DataFrame, config: EngineConfig = DEFAULT_CONFIG, mode: str = "pattern") -> DataFrame:
    clean = metadata.clean_messages(messages, config, mode)
    return metadata.metadata_columns(clean, "clean_text", config, mode).select(
        "email_id", "sender_domain", "urls", "footer_text")


def pii_scan(df: DataFrame, key: str, text: str, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    spans = pii.pii_spans(df.select(key, text), text)
    return {
        "spans": pii.resolve_overlaps(pii.apply_thresholds(spans), key),
        "values": pii.pii_extract(df, key, text),
        "per_message": spans.groupBy(key, "entity_type").agg(F.count(F.lit(1)).alias("spans")),
        "totals": pii.pii_stats(df, text, by),
    }


def pii_redact(df: DataFrame, text: str, way: str = "mask") -> DataFrame:
    rewrite = {"mask": pii.mask, "replace": pii.replace, "hash": pii.hash_spans, "default": pii.rewrite_by_entity}[way]
    return df.withColumn(text, rewrite(F.col(text)))


def enrich_sites(sites: DataFrame, site: str, pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    return privacy.site_policies(sites, site, pages, page_id, url, html)


def result_reports(results: DataFrame, config: EngineConfig = DEFAULT_CONFIG) -> dict[str, DataFrame]:
    return {
        "statistics": store.result_stats(results),
        "categories": reports.category_shares(results),
        "summary": reports.run_summary(results),
        "high_confidence": reports.high_confidence_count(results, config),
        "latency": reports.latency_check(results, config),
    }
