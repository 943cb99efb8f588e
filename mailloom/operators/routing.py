"""Domain-first search: which index rows can be a confident match of a query, without a search for every query.

Where the weight of unrelated domains alone keeps a candidate below the threshold, only candidates of the same or a related
domain can be confident. Related domains share their last two labels, or one of them is a single label and the last of
the other; so an equi-join on these keys brings all of them together, and a query never travels to blocks of other
domains. A domain with many index rows is dealt into blocks, and one with many queries into shares. What is near enough
is a survivor. Only the queries of survivors are then searched in the whole index, no farther than their survivors,
to see whether these are among the nearest of all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.config import EngineConfig
from mailloom.functions import domains
from mailloom.functions.text import strip_whitespace
from mailloom.operators import neighbours as nb
from mailloom.operators.skew import cut_lineage


def normal_domain(c: Column) -> Column:
    """A domain as weights compare it; null where there is none."""
    return F.when(F.coalesce(c, F.lit("")) != "", strip_whitespace(F.lower(c)))


def _last_label(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def _keyed(df: DataFrame, domain: str, other: DataFrame, other_domain: str, single: str, several: str) -> DataFrame:
    """df, a row per key: the root of its domain, and the last label where the other side needs it. Only the few keys
    of the other side's single labels are made for domains of several labels."""
    own = df.withColumn("_domain", normal_domain(F.col(domain))).where(F.col("_domain").isNotNull())
    has_one = ~F.contains(F.col("_domain"), F.lit("."))
    roots = own.withColumn("_key", F.concat(F.lit("r:"), domains.root_domain(F.col("_domain"))))
    theirs = other.select(normal_domain(F.col(other_domain)).alias("_label")).where(
        F.col("_label").isNotNull() & ~F.contains(F.col("_label"), F.lit("."))).distinct()
    below = own.where(~has_one).withColumn("_label", _last_label(F.col("_domain"))).join(
        theirs, "_label", "left_semi").withColumn("_key", F.concat(F.lit(several), "_label")).drop("_label")
    ones = own.where(has_one).withColumn("_key", F.concat(F.lit(single), "_domain"))
    return roots.unionByName(below.select(*roots.columns)).unionByName(ones).drop("_domain")


def related_neighbours(
    queries: DataFrame, index: DataFrame, k: int, *, query_id: str, index_id: str, query_vec: str, index_vec: str,
    query_domain: str, candidate_domain: str, keep: Sequence[str], metric: str, within: float | None,
    skip_self: bool = False, block_rows: int | None = None,
) -> DataFrame:
    """The k nearest of each query among index rows of the same or a related domain."""
    q = nb.usable(queries, query_id, [query_domain], query_vec, "_qv", metric)
    c = nb.usable(index, index_id, [candidate_domain, *keep], index_vec, "_cv", metric)
    rows = block_rows or nb.default_block_rows(c, "_cv")
    left = _keyed(q, query_domain, c, candidate_domain, "s:", "t:")
    right = _keyed(c, candidate_domain, q, query_domain, "t:", "s:")
    left, right = nb.deal_blocks(left, right, ["_key"], query_id, index_id, rows)
    found = nb.block_neighbours(
        left, right, ["_key", "_block", "_share"], k, query_id=query_id, index_id=index_id, query_cols=[query_domain],
        index_cols=[candidate_domain, *keep], metric=metric, within=within, skip_self=skip_self)
    return nb.keep_nearest(found, query_id, index_id, k)


def applies(config: EngineConfig) -> bool:
    """Whether no candidate of an unrelated domain can be confident, as no similarity is above 1."""
    return 0 < config.confidence_threshold and config.default_domain_weight <= config.confidence_threshold


def survivors(queries: DataFrame, index: DataFrame, config: EngineConfig, reach: float, *, query_id: str, index_id: str,
              query_vec: str, index_vec: str, query_domain: str, candidate_domain: str, keep: Sequence[str] = (),
              metric: str = "sql2", skip_self: bool = False, block_rows: int | None = None) -> DataFrame:
    """(query, index row, distance, rank) of all candidates that are confident and among the ``match_candidates`` nearest
    rows of the whole index. ``reach`` is the distance beyond which none is confident."""
    names = dict(query_id=query_id, index_id=index_id, query_vec=query_vec, index_vec=index_vec, metric=metric,
                 skip_self=skip_self, block_rows=block_rows)
    near = related_neighbours(
        queries, index, config.match_candidates, query_domain=query_domain, candidate_domain=candidate_domain, keep=keep,
        within=reach, **names)
    weight = domains.domain_weight(F.col(query_domain), F.col(candidate_domain), config)
    sure = cut_lineage(near.where((1.0 - F.col("distance")) * weight > config.confidence_threshold).drop("rank"))
    scale = 2.0 if metric == "cosine" else 1.0
    bound = sure.groupBy(query_id).agg(
        (F.sqrt(F.greatest(F.max("distance"), F.lit(0.0)) * scale) + nb.SLACK).alias("_bound"))
    asked = cut_lineage(queries.select(query_id, query_vec).join(bound, query_id))
    ranked = nb.knn(asked, index, config.match_candidates, within=reach, known_reach="_bound", **names)
    return sure.join(ranked.select(query_id, index_id, "rank"), [query_id, index_id])
