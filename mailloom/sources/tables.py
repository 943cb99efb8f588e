"""The engine's inputs as views on general tables of texts, pages, vectors and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.functions import links

INDEX_CATEGORIES = ("marketing", "transactional", "survey", "personal", "customer_support")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_messages(documents: DataFrame) -> DataFrame:
    """Plain-text messages: sender domain from language and source."""
    domain = F.concat(F.col("lang"), F.lit("."), F.col("source"), F.lit(".example"))
    return documents.select(
        F.col("doc_id").alias("email_id"),
        F.concat(F.lit("u"), F.col("doc_id"), F.lit("@"), domain).alias("from_email"),
        F.concat(F.lit("Message "), F.col("doc_id")).alias("subject"),
        F.lit(None).cast("string").alias("html_content"), F.col("text").alias("text_content"),
    )


def html_messages(pages: DataFrame) -> DataFrame:
    """HTML messages: sender domain from the page's host."""
    return pages.select(
        F.col("page_id").alias("email_id"),
        F.concat(F.lit("news@"), links.url_host(F.col("url"))).alias("from_email"),
        F.col("url").alias("subject"),
        F.col("html").alias("html_content"), F.lit(None).cast("string").alias("text_content"),
    )


def raw_messages(documents: DataFrame) -> DataFrame:
    """JSON messages. Texts of one language come under another key, another's HTML is null beside the text, and the
    messages of one source lack their last character, so that every kind of problem occurs in whole messages."""
    sender = F.concat(F.lit("u"), F.col("doc_id"), F.lit("@"), F.col("source"), F.lit(".example"))
    subject = F.concat(F.lit("Message "), F.col("doc_id"))
    whole = F.to_json(F.struct(sender.alias("from"), subject.alias("subject"), F.col("text").alias("html_content")))
    empty = F.concat(
        F.regexp_replace(F.to_json(F.struct(
            sender.alias("from"), subject.alias("subject"), F.col("text").alias("text_content"))), r"\}$", ""),
        F.lit(',"html_content":null}'))
    bodiless = F.to_json(F.struct(
        sender.alias("from_email"), subject.alias("subject"), F.col("text").alias("text_content")))
    text = F.when(F.col("lang") == "de", bodiless).when(F.col("lang") == "es", empty).otherwise(whole)
    cut = F.left(text, F.char_length(text) - 1)
    return documents.select(
        F.col("doc_id").alias("email_id"),
        F.when(F.col("source") == "src3", cut).otherwise(text).alias("raw"))


def vector_index(embeddings: DataFrame) -> DataFrame:
    """Index entries whose domains give equal, related and unrelated pairs."""
    names = F.array(*[F.lit(c) for c in INDEX_CATEGORIES])
    domain = F.concat(
        F.lit("m"), F.col("vec_id") % 3, F.lit(".r"), F.col("label") % 4, F.lit(".example"))
    return embeddings.select(
        F.col("vec_id").alias("id"), "embedding", domain.alias("sender_domain"),
        F.element_at(names, (F.col("label") % 5 + 1).cast("int")).alias("email_category"),
        F.concat(F.lit("Company "), F.col("label")).alias("business_name"),
        F.when(F.col("label") % 2 == 0, F.concat(F.lit("industry "), F.col("label") % 3)).alias("business_industry"),
    )


def stored_results(events: DataFrame) -> DataFrame:
    """Stored results: one per event, one sender domain per user."""
    kinds = {"view": 0, "click": 1, "error": 2, "signup": 3, "purchase": 4}
    category = None
    for kind, i in kinds.items():
        hit = F.col("event_type") == kind
        value = F.lit(INDEX_CATEGORIES[i])
        category = F.when(hit, value) if category is None else category.when(hit, value)
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id"), F.lit(".example")).alias("sender_domain"),
        F.col("ts").alias("processed_at"), category.alias("email_category"),
        (F.col("value") / (F.col("value") + 1)).alias("confidence_score"),
        (F.col("value") / 50).alias("processing_time"),
    )


def crawled_pages(documents: DataFrame) -> DataFrame:
    """A crawl: each text is a page of its site, at one of the usual places or elsewhere."""
    paths = F.array(*[F.lit(p) for p in rules.PRIVACY_PATHS])
    place = F.col("doc_id") % 12 + 1
    path = F.coalesce(F.try_element_at(paths, place.cast("int")), F.concat(F.lit("/post/"), F.col("doc_id")))
    return documents.select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("https://"), F.col("lang"), F.lit("."), F.col("source"), F.lit(".example"), path).alias("url"),
        F.col("text").alias("html"),
    )


def site_of_text() -> Column:
    """The site a text belongs to."""
    return F.concat(F.col("lang"), F.lit("."), F.col("source"), F.lit(".example"))
