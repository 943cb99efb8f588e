"""Exact deduplication: a tree merge of sorted digest runs.

Each partition of the input makes one sorted run of digests. The runs then meet in binomial rounds: there are
fan_in ** k nodes, and in round r the nodes whose numbers differ only in digit r (base fan_in) exchange pieces of their
runs, so that digit r of a row's node becomes digit r of its digest's range. Each node merges the fan_in pieces that it
gets and keeps, of equal digests, one row with the best identifier and the number of copies. After k rounds each node
holds one range of digests, each digest once.

A group of copies collapses to one row per run before anything moves, and no node ever gets more than fan_in rows of
one digest. The way back takes at most one row per run and digest (common.look_up).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.llm.common import look_up, rows_named, shuffle_partitions, stored, text_of

FAN_IN = 8


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node, digest and rank of identifier -> the first of each node and digest, with the summed n.

    Only the last group of a batch is held, since it may go on in the next. Equal digests of unequal lengths stop the
    job: they would be different texts.
    """
    held = None
    for batch in batches:
        rows = pa.Table.from_arrays(batch.columns, batch.schema.names)
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        node, digest = rows["node"].combine_chunks(), rows["digest"].combine_chunks()
        same = pc.and_(pc.equal(node[1:], node[:-1]), pc.equal(digest[1:], digest[:-1]))
        starts = np.flatnonzero(np.r_[True, ~same.to_numpy(zero_copy_only=False)])
        lengths = rows["n_bytes"].to_numpy()
        if (np.minimum.reduceat(lengths, starts) != np.maximum.reduceat(lengths, starts)).any():
            raise ValueError("equal digests of texts of unequal length")
        copies = np.add.reduceat(rows["n"].to_numpy(), starts)
        rows = rows.take(pa.array(starts))
        rows = rows.set_column(rows.schema.get_field_index("n"), "n", pa.array(copies, pa.int64()))
        yield from rows.slice(0, rows.num_rows - 1).to_batches()
        held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield from held.to_batches()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
          fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: doc_id, digest (32 bytes), keep_id, group_size, kept.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest (or smallest)
    identifier stays; a null identifier loses against any other, and of rows that tie in it exactly one stays. Other
    columns, whatever their names, aren't looked at. An empty table gives no rows. Equality means equal SHA-256 and
    equal length; the digest is of the whole text.
    """
    text = text_of(docs[text_col])
    slim = stored(docs.select(
        docs[id_col].alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("slot"), F.monotonically_increasing_id().alias("pos"),
    ), "digests")
    groups = merged(slim, keep, fan_in)
    return look_up(slim, groups, ["digest"]).select(
        "doc_id", "digest", "keep_id", "group_size", (F.col("pos") == F.col("keep_pos")).alias("kept"))


def merged(slim: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, digest, n_bytes, slot, pos) -> one row per digest: digest, keep_id, keep_pos, group_size."""
    rounds = 1
    while fan_in ** rounds < shuffle_partitions(slim.sparkSession):
        rounds += 1
    nodes = fan_in ** rounds
    best = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    order = ["node", "digest", best, "pos"]
    runs = slim.select((F.col("slot") % nodes).alias("node"), "digest", "n_bytes", "doc_id", "pos",
                       F.lit(1).cast("long").alias("n"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in runs.schema])
    runs = runs.sortWithinPartitions(*order).mapInArrow(merge_runs, schema)
    top = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    home = F.shiftright(top * nodes, 32).cast("int")
    for r in range(rounds):
        step = fan_in ** r
        digit = lambda c, step=step: F.floor(c / step).cast("int") % fan_in
        moved = F.col("node") + (digit(home) - digit(F.col("node"))) * step
        runs = (runs.withColumn("node", moved).repartitionById(nodes, F.col("node"))
                .sortWithinPartitions(*order).mapInArrow(merge_runs, schema))
    return runs.select("digest", F.col("doc_id").alias("keep_id"), F.col("pos").alias("keep_pos"),
                       F.col("n").alias("group_size"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, one per text, with all their columns."""
    found = dedup(docs, id_col, text_col, keep)
    return rows_named(docs, found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))), id_col, text_col)
