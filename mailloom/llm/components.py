"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import look_up, shuffle_partitions, stored


def dealt(df: DataFrame, column: str) -> DataFrame:
    """df with a slot that spreads rows by a column of distinct values."""
    return df.withColumn("slot", F.pmod(F.xxhash64(column), F.lit(max(8, shuffle_partitions(df.sparkSession)))))


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long nodes -> (node, root) for every linked node; root is the component's smallest node.

    In each round every node points to its smallest neighbour or itself, and links between nodes become links between
    what they point to. Stars and dense groups vanish in a round or two; a path whose numbers rise along it is the
    worst case and loses one node a round. The pointers are then followed through the rounds. Nulls and self links are ignored; no links give no rows.
    """
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("to")), "pointers")
        rounds.append(to)
        left = look_up(dealt(links, "b").withColumnRenamed("a", "node"), to, ["node"])
        left = left.select(F.col("to").alias("a"), F.col("b").alias("node"))
        both = look_up(dealt(left, "a"), to, ["node"]).select("a", F.col("to").alias("b"))
        links = stored(both.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0].select(F.col("node").alias("at"), F.col("to").alias("node"))
    for to in rounds[1:]:
        found = look_up(dealt(found, "at"), to, ["node"])
        found = found.select("at", F.coalesce("to", "node").alias("node"))
    return found.select(F.col("at").alias("node"), F.col("node").alias("root"))
