"""From nearest neighbours to a confidence, a best match and a route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.config import DEFAULT_CONFIG, EngineConfig
from mailloom.functions import domains, links
from mailloom.operators import routing
from mailloom.operators.batches import earlier_neighbours
from mailloom.operators.neighbours import knn


def embedding_text(content: Column, sender_domain: Column, footer: Column, urls: Column) -> Column:
    """The text that stands for a message in the index; hosts are sorted to be repeatable."""
    hosts = F.array_sort(links.url_hosts(F.coalesce(urls, F.array().cast("array<string>"))))
    return F.concat_ws(
        "\n",
        F.coalesce(content, F.lit("")),
        F.concat(F.lit("Domain: "), sender_domain),
        F.when(footer != "", F.concat(F.lit("Footer: "), footer)),
        F.when(F.size(hosts) > 0, F.concat(F.lit("URL domains: "), F.array_join(hosts, ", "))),
    )


def score(
    neighbours: DataFrame, query_domain: str, candidate_domain: str, config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """similarity = 1 - distance, domain_weight, and their product as confidence."""
    return neighbours.withColumns({
        "similarity": 1.0 - F.col("distance"),
        "domain_weight": domains.domain_weight(F.col(query_domain), F.col(candidate_domain), config),
    }).withColumn("confidence", F.col("similarity") * F.col("domain_weight"))


def best_match(scored: DataFrame, query_id: str, index_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """The candidate of highest confidence per query; the nearer one, then the lower id, on ties."""
    fields = [index_id, "similarity", "domain_weight", "confidence", *keep]
    order = F.struct(-F.col("confidence"), F.col("distance"), F.col(index_id))
    best = F.min_by(F.struct(*fields), order).alias("m")
    return scored.groupBy(query_id).agg(best).select(query_id, "m.*")


def reach_of(config: EngineConfig) -> float | None:
    """The distance beyond which no candidate can be confident, whatever its domain.

    Everything nearer than a candidate in reach is itself in reach, so ranks inside the reach
    are the true ranks. Needs a positive threshold.
    """
    if config.confidence_threshold <= 0:
        return None
    return 1.0 - config.confidence_threshold / config.max_domain_weight


def is_confident(confidence: Column, config: EngineConfig = DEFAULT_CONFIG) -> Column:
    return confidence > config.confidence_threshold


def match(
    queries: DataFrame,
    index: DataFrame,
    *,
    query_id: str,
    index_id: str,
    query_domain: str,
    candidate_domain: str,
    query_vec: str = "q_vec",
    index_vec: str = "c_vec",
    keep: Sequence[str] = (),
    metric: str = "sql2",
    confident_only: bool = False,
    config: EngineConfig = DEFAULT_CONFIG,
    skip_self: bool = False,
    block_rows: int | None = None,
    domain_first: bool = True,
) -> DataFrame:
    """Best match of each query among its nearest index rows.

    With ``confident_only`` the search itself is bounded by the reach of the threshold; and where no unrelated domain can
    be confident, candidates are looked for by domain first (``routing``). ``domain_first=False`` searches for all.
    """
    reach = reach_of(config) if confident_only else None
    names = dict(query_id=query_id, query_vec=query_vec, index_id=index_id, index_vec=index_vec, metric=metric,
                 skip_self=skip_self, block_rows=block_rows)
    if confident_only and domain_first and routing.applies(config):
        near = routing.survivors(
            queries, index, config, reach, query_domain=query_domain, candidate_domain=candidate_domain, keep=keep, **names)
    else:
        near = knn(queries, index, config.match_candidates, query_cols=[query_domain],
                   index_cols=[candidate_domain, *keep], within=reach, **names)
    best = best_match(
        score(near, query_domain, candidate_domain, config), query_id, index_id, [candidate_domain, *keep])
    return best.where(is_confident(F.col("confidence"), config)) if confident_only else best


def match_earlier(
    queries: DataFrame, index: DataFrame, *, query_id: str, index_id: str, query_domain: str, candidate_domain: str,
    query_batch: str, index_batch: str, query_vec: str = "q_vec", index_vec: str = "c_vec", keep: Sequence[str] = (),
    metric: str = "sql2", confident_only: bool = False, config: EngineConfig = DEFAULT_CONFIG, block_rows: int | None = None,
) -> DataFrame:
    """Best match of each query among its nearest index rows of earlier batches: the index as each batch found it, in one
    plan for all batches."""
    near = earlier_neighbours(
        queries, index, config.match_candidates, query_id=query_id, query_vec=query_vec, query_batch=query_batch,
        index_id=index_id, index_vec=index_vec, index_batch=index_batch, query_cols=[query_domain],
        index_cols=[candidate_domain, *keep], metric=metric, within=reach_of(config) if confident_only else None,
        block_rows=block_rows)
    best = best_match(
        score(near, query_domain, candidate_domain, config), query_id, index_id, [candidate_domain, index_batch, *keep])
    return best.where(is_confident(F.col("confidence"), config)) if confident_only else best


def category_from_match(c: Column) -> Column:
    return F.when(c.isin(*rules.CATEGORIES), c).otherwise(F.lit(rules.DEFAULT_CATEGORY))


def entity_from_match(
    name: Column, website: Column, dpo_email: Column, industry: Column, location: Column,
) -> Column:
    return F.struct(
        F.coalesce(name, F.lit("Unknown")).alias("name"), website.alias("website"),
        dpo_email.alias("dpo_email"), industry.alias("industry"), location.alias("location"),
    )


def match_stats(matches: DataFrame, config: EngineConfig = DEFAULT_CONFIG) -> DataFrame:
    """One row of totals and means; zeros for no matches."""
    def mean(c):
        return F.coalesce(F.round(F.avg(c), 3), F.lit(0.0))

    return matches.agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.count(F.when(is_confident(F.col("confidence"), config), 1)).alias("confident_matches"),
        mean("confidence").alias("avg_confidence"), mean("similarity").alias("avg_similarity"),
    )


def match_domains(matches: DataFrame, domain: str) -> DataFrame:
    """Matches per candidate domain."""
    return (
        matches.groupBy(F.coalesce(domain, F.lit("unknown")).alias("sender_domain"))
        .agg(F.count(F.lit(1)).alias("matches"))
    )


def index_stats(index: DataFrame, columns: Sequence[str] = ("sender_domain", "email_category", "business_industry")) -> DataFrame:
    """Documents per distinct value of each column, as rows (field, value, documents).

    The lists stay distributed: an index may know more domains than one row could hold.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])
    return (
        index.select(F.explode(pairs).alias("p")).select("p.*")
        .where(F.coalesce("value", F.lit("")) != "")
        .groupBy("field", "value").agg(F.count(F.lit(1)).alias("documents"))
    )


def index_totals(
    index: DataFrame, columns: Sequence[str] = ("sender_domain", "email_category", "business_industry"),
    approximate: bool = False,
) -> DataFrame:
    """One row: documents, and distinct non-blank values of each column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    parts = [count(F.when(F.col(c) != "", F.col(c))).alias(f"distinct_{c}") for c in columns]
    return index.agg(F.count(F.lit(1)).alias("total_documents"), *parts)


def delete_ids(index: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return index.join(ids.select(key), key, "left_anti")


def peek(index: DataFrame, n: int, key: str = "id") -> DataFrame:
    return index.orderBy(key).limit(n)
