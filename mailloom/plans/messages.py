"""The whole way of a table of messages: clean, mask, describe, match, route, enrich."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.config import DEFAULT_CONFIG, EngineConfig
from mailloom.operators import classify, pii, similarity
from mailloom.operators.embed import embed
from mailloom.operators.metadata import clean_messages, metadata_columns
from mailloom.operators.privacy import enrich_dpo, site_policies
from mailloom.operators.skew import cut_lineage
from mailloom.rules import DpoWords


@dataclass(frozen=True)
class Hooks:
    """What a user may plug in. Each model takes and returns pandas series. ``replies`` is a folder in which replies
    to prompts are kept, so that no run asks what an earlier one was answered."""

    embed: Callable | None = None
    classify: Callable | None = None
    dpo: Callable | None = None
    entities: Callable | None = None
    replies: str | None = None

    def kept(self, what: str) -> str | None:
        return None if self.replies is None else f"{self.replies.rstrip('/')}/{what}"


@dataclass(frozen=True)
class PageTable:
    """Crawled pages and the names of their columns."""

    rows: DataFrame
    page_id: str = "page_id"
    url: str = "url"
    html: str = "html"
    words: DpoWords = DpoWords()
    paths: Sequence[str] = rules.PRIVACY_PATHS


def describe(
    messages: DataFrame, config: EngineConfig = DEFAULT_CONFIG, hooks: Hooks = Hooks(),
    mode: str = "pattern", data_source: str = "original",
) -> DataFrame:
    """Everything that is known of a message by itself; no shuffle.

    ``data_source`` says whether user data is read from the original or the masked text.
    """
    clean = metadata_columns(clean_messages(messages, config, mode), "clean_text", config, mode)
    if hooks.entities is not None:
        clean = clean.withColumn("_spans", pii.entity_spans(F.col("clean_text"), hooks.entities, config.model_score))
    masked = clean.withColumn("masked_text", pii.mask(
        F.col("clean_text"), config.pii_entities, char=config.pii_mask_char,
        extra=F.col("_spans") if hooks.entities is not None else None,
        thresholds=config.entity_thresholds, least=config.score_threshold))
    read_from = "clean_text" if data_source == "original" else "masked_text"
    described = masked.withColumn("data", pii.extract(F.col(read_from))).withColumn(
        "document", similarity.embedding_text(
            F.col("masked_text"), F.col("sender_domain"), F.col("footer_text"), F.col("urls")))
    slim = described.select(
        "email_id", "from_email", "subject", "masked_text", "sender_domain", "footer_text", "urls", "data", "document")
    return embed(slim, "document", hooks.embed)


_MATCH = (
    "email_category", "business_name", "business_website", "business_industry", "business_location", "dpo_email",
)


def match_index(
    described: DataFrame, index: DataFrame, config: EngineConfig = DEFAULT_CONFIG, metric: str = "sql2",
    block_rows: int | None = None,
) -> DataFrame:
    """Confident matches only: (email_id, match_confidence, match_distance, m_...)."""
    queries = described.select("email_id", F.col("sender_domain").alias("q_domain"), F.col("embedding").alias("q_vec"))
    entries = index.select(
        F.col("id").alias("c_id"), F.col("embedding").alias("c_vec"), F.col("sender_domain").alias("c_domain"),
        *[F.col(c).alias(f"m_{c}") for c in _MATCH])
    best = similarity.match(
        queries, entries, query_id="email_id", index_id="c_id", query_domain="q_domain",
        candidate_domain="c_domain", keep=[f"m_{c}" for c in _MATCH], metric=metric,
        confident_only=config.confidence_threshold > 0, config=config, block_rows=block_rows)
    best = best.where(similarity.is_confident(F.col("confidence"), config))
    return best.select(
        "email_id", F.col("confidence").alias("match_confidence"),
        (1.0 - F.col("similarity")).alias("match_distance"), *[f"m_{c}" for c in _MATCH])


def _from_match() -> Column:
    return F.struct(
        similarity.category_from_match(F.col("m_email_category")).alias("email_category"),
        similarity.entity_from_match(
            F.col("m_business_name"), F.col("m_business_website"), F.col("m_dpo_email"),
            F.col("m_business_industry"), F.col("m_business_location")).alias("business_entity"),
        classify.no_data().alias("data"),
        F.col("match_confidence").alias("confidence_score"),
    )


def route(
    described: DataFrame, matches: DataFrame, hooks: Hooks = Hooks(),
    table: classify.Keywords = rules.CATEGORY_KEYWORDS,
) -> DataFrame:
    """Copy from a confident match, else classify; only the rest is ever sent to a model."""
    matched = F.col("match_confidence").isNotNull()
    if hooks.classify is None:
        # What the rules say is settled where the text is, so that no body travels to the join.
        rest = classify.fallback_result(F.col("masked_text"), F.col("sender_domain"), F.col("urls"), table)
        slim = described.withColumn("_rest", rest).drop("masked_text", "subject", "from_email")
        routed = slim.join(matches, "email_id", "left").withColumn(
            "result", F.when(matched, _from_match()).otherwise(F.col("_rest"))).drop("_rest")
    else:
        joined = cut_lineage(described.join(matches, "email_id", "left"))
        rest = classify.classify_with_model(
            joined.where(~matched), hooks.classify, "masked_text", table, kept=hooks.kept("classify"))
        routed = joined.where(matched).withColumn("result", _from_match()).unionByName(rest)
    return routed.withColumn("route", F.when(matched, F.lit("match")).otherwise(F.lit("classifier"))).drop(
        "match_confidence", *[f"m_{c}" for c in _MATCH])


def finish(routed: DataFrame) -> DataFrame:
    """Processed messages. User data always comes from the message, not from a model's reply."""
    return routed.select(
        "email_id", "route", "result.email_category", "result.business_entity", "data",
        F.col("result.confidence_score").alias("confidence_score"),
        F.struct("sender_domain", "footer_text", "urls").alias("metadata"),
        "document", "embedding", "match_distance",
    )


def enrich(processed: DataFrame, pages: PageTable, hooks: Hooks = Hooks()) -> DataFrame:
    """Fill in missing data-protection addresses from crawled pages."""
    entity = F.col("business_entity")
    # Only identifiers, sites and addresses are stored for this; the rows themselves meet the outcome in one join.
    keys = cut_lineage(processed.select("email_id", entity["website"].alias("_web"), entity["dpo_email"].alias("_dpo")).distinct())
    wanted = keys.where((F.coalesce("_dpo", F.lit("")) == "") & F.col("_web").isNotNull())
    policies = site_policies(
        wanted.select(F.col("_web").alias("site")), "site", pages.rows, pages.page_id, pages.url, pages.html,
        pages.words, pages.paths, hooks.dpo, hooks.kept("dpo"))
    filled = enrich_dpo(wanted, policies, "_web", "_dpo", "site").where(F.coalesce("_dpo", F.lit("")) != "")
    filled = filled.select("email_id", "_web", "_dpo").distinct().groupBy("email_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_web", "_dpo"))).alias("_found"))
    joined = processed.join(filled, "email_id", "left")
    missing = F.coalesce(entity["dpo_email"], F.lit("")) == ""
    dpo = F.coalesce(F.when(missing, F.try_element_at("_found", entity["website"])), entity["dpo_email"])
    return joined.withColumn("business_entity", entity.withField("dpo_email", dpo)).drop("_found")


def process_messages(
    messages: DataFrame,
    index: DataFrame,
    *,
    pages: PageTable | None = None,
    config: EngineConfig = DEFAULT_CONFIG,
    hooks: Hooks = Hooks(),
    table: classify.Keywords = rules.CATEGORY_KEYWORDS,
    metric: str = "sql2",
    mode: str = "pattern",
    data_source: str = "original",
    block_rows: int | None = None,
) -> DataFrame:
    """Process messages (email_id, from_email, subject, html_content, text_content) against an
    index. Described messages are read several times, so they are stored once in between."""
    described = cut_lineage(describe(messages, config, hooks, mode, data_source))
    matches = cut_lineage(match_index(described, index, config, metric, block_rows))
    processed = finish(route(described, matches, hooks, table))
    return processed if pages is None else enrich(processed, pages, hooks)


def index_entries(
    processed: DataFrame, config: EngineConfig = DEFAULT_CONFIG, dedup_distance: float | None = None,
) -> DataFrame:
    """Index entries of the confident results.

    ``dedup_distance`` leaves out messages that lie nearer than that to the entry they matched.
    """
    rows = processed.where(F.col("confidence_score") > config.confidence_threshold)
    if dedup_distance is not None:
        rows = rows.where(F.coalesce(F.col("match_distance"), F.lit(float("inf"))) >= dedup_distance)
    entity, meta = F.col("business_entity"), F.col("metadata")
    return rows.select(
        F.col("email_id").cast("string").alias("id"), "embedding", "document",
        meta["sender_domain"].alias("sender_domain"), "email_category",
        entity["name"].alias("business_name"), entity["website"].alias("business_website"),
        entity["industry"].alias("business_industry"), entity["location"].alias("business_location"),
        entity["dpo_email"].alias("dpo_email"), "confidence_score",
        F.size(meta["urls"]).alias("urls_count"),
        (F.coalesce(meta["footer_text"], F.lit("")) != "").alias("has_footer"),
    )
