"""Rows of a batch against everything of earlier batches, for all batches in one plan.

"Earlier than batch n" is a range of batch numbers, and a range that starts at 0 is the union of one aligned interval of
2 ** l batches per bit of n. An index row belongs to one such interval per level, a query asks for those of its bits. So
both meet by equality, a query is copied once per bit of its number, and no batch needs a search of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.operators import neighbours as nb


def earlier_neighbours(
    queries: DataFrame, index: DataFrame, k: int = 5, *, query_id: str = "q_id", query_vec: str = "q_vec",
    query_batch: str = "q_batch", index_id: str = "c_id", index_vec: str = "c_vec", index_batch: str = "c_batch",
    query_cols: Sequence[str] = (), index_cols: Sequence[str] = (), metric: str = "sql2", within: float | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """The k nearest index rows of smaller batch number for each query: (query, index row, distance, rank).

    Batch numbers are whole and not negative; rows without one take no part. Many rows of an interval are dealt into
    blocks, and many queries into shares.
    """
    q = nb.usable(queries, query_id, [query_batch, *query_cols], query_vec, "_qv", metric).where(F.col(query_batch) >= 0)
    c = nb.usable(index, index_id, [index_batch, *index_cols], index_vec, "_cv", metric).where(F.col(index_batch) >= 0)
    highest = q.agg(F.max(query_batch).cast("long")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(max(0, highest.bit_length() - 1)))

    def node(batch: str, level: Column) -> Column:
        return F.call_function("shiftright", F.col(batch).cast("long"), level)

    asked = F.transform(F.filter(levels, lambda level: F.pmod(node(query_batch, level), F.lit(2)) == 1), lambda level: F.struct(
        level.alias("_level"), (node(query_batch, level) - 1).alias("_node")))
    given = F.transform(levels, lambda level: F.struct(level.alias("_level"), node(index_batch, level).alias("_node")))
    left = q.withColumn("_at", F.explode(asked)).select("*", "_at.*").drop("_at")
    right = c.withColumn("_at", F.explode(given)).select("*", "_at.*").drop("_at")
    keys = ["_level", "_node"]
    rows = block_rows or nb.default_block_rows(c, "_cv")
    left, right = nb.deal_blocks(left, right, keys, query_id, index_id, rows)
    found = nb.block_neighbours(
        left, right, [*keys, "_block", "_share"], k, query_id=query_id, index_id=index_id,
        query_cols=[query_batch, *query_cols], index_cols=[index_batch, *index_cols], metric=metric, within=within, skip_self=False)
    return nb.keep_nearest(found, query_id, index_id, k)
