"""Nearest neighbours by random projections: approximate, or as a head start for the exact way.

A hash table cuts a few random projections into stretches; the joint stretch is a vector's bucket. A near neighbour that
misses a query's bucket mostly lies in one of the neighbouring ones, across the boundaries that the query is nearest to.
So a query also probes other buckets of each table, in the order of the distance to their boundaries. How many it probes is
not a guess: the exact neighbours of a bounded sample of queries say how far down that order the buckets have to be
read for the wanted recall, at whatever size the index has.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.operators import neighbours as nb
from mailloom.operators.skew import cut_lineage

#: Rows of a bucket that the default number of projections aims at, and the values that a projection typically takes.
BUCKET_ROWS = 256
VALUES = 3.0
#: Wanted recall, queries that it is measured on, and buckets of a table that a query probes at most.
RECALL = 0.95
SAMPLE = 200
MOST_PROBES = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shift_sets(width: int, most: int) -> list[tuple[int, ...]]:
    """Sets of boundary crossings, likeliest first, as places in a query's 2 * width crossings sorted by distance.

    Expected squared distances of sorted uniform crossings rank the sets once for all queries. Places j and
    2 * width - 1 - j are the two sides of one projection, so no set has both.
    """
    if width == 0:
        return [()]
    cost = [j * (j + 1) / (4 * (width + 1) * (width + 2)) for j in range(1, width + 1)]
    cost += [1 - (2 * width + 1 - j) / (width + 1) + (2 * width + 1 - j) * (2 * width + 2 - j) / (4 * (width + 1) * (width + 2))
             for j in range(width + 1, 2 * width + 1)]
    found, heap = [()], [(cost[0], (0,))]
    while heap and len(found) < most:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if all(2 * width - 1 - j not in chosen for j in chosen):
            found.append(chosen)
        if last + 1 < 2 * width:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return found


@dataclass(frozen=True)
class Tables:
    """Random projections: ``tables`` of ``width`` each, cut into stretches of ``length``."""

    directions: np.ndarray
    offsets: np.ndarray
    length: float
    tables: int
    width: int
    unit: bool

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Positions of vectors in stretches, (rows, tables, width)."""
        at = (vectors @ self.directions.T) / self.length + self.offsets
        return at.reshape(len(vectors), self.tables, self.width)

    @staticmethod
    def buckets(stretches: np.ndarray) -> np.ndarray:
        """One number per joint stretch. Two that coincide by chance only give more candidates."""
        found = np.zeros(stretches.shape[:-1], np.uint64)
        for i in range(stretches.shape[-1]):
            found = (found ^ stretches[..., i].astype(np.int64).view(np.uint64)) * _MIX
            found ^= found >> np.uint64(29)
        return found.view(np.int64)

    def own(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector."""
        return self.buckets(np.floor(self.places(vectors)))

    def probed(self, vectors: np.ndarray, sets: Sequence[tuple[int, ...]]) -> np.ndarray:
        """(rows, tables, sets): the buckets that each query probes, its own first."""
        at = self.places(vectors)
        low = np.floor(at)
        inside = at - low
        crossings = np.concatenate([inside, 1.0 - inside], axis=2)  # down, then up
        order = np.argsort(crossings, axis=2, kind="stable")
        out = np.empty((*at.shape[:2], len(sets)), np.int64)
        rows, tables = np.indices(at.shape[:2])
        for i, chosen in enumerate(sets):
            stretch = low.copy()
            for j in chosen:
                side = order[:, :, j]
                np.add.at(stretch, (rows, tables, side % max(1, self.width)), np.where(side < self.width, -1.0, 1.0))
            out[:, :, i] = self.buckets(stretch)
        return out


def _scattered(df: DataFrame, vec: str, model: Tables, sets: Sequence[tuple[int, ...]] | None) -> DataFrame:
    """One row per bucket of each row of df: its own in every table, or all that it probes."""
    schema = T.StructType([*df.schema.fields, T.StructField("_table", T.IntegerType()), T.StructField("_bucket", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, nb.CHUNK_CELLS // (model.tables * len(sets or [0])))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vectors = nb.matrix(part.column(vec), model.unit)
                found = model.own(vectors)[:, :, None] if sets is None else model.probed(vectors, sets)
                row = np.repeat(np.arange(len(vectors), dtype=np.int32), model.tables * found.shape[2])
                table = np.tile(np.repeat(np.arange(model.tables, dtype=np.int32), found.shape[2]), len(vectors))
                yield from nb.copies(part, row, {"_table": table, "_bucket": found.ravel()})

    return df.mapInArrow(run, schema)


def _drawn(dim: int, length: float, tables: int, width: int, unit: bool, seed: int) -> Tables:
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((tables * width, dim))
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-300)
    return Tables(directions, rng.random(tables * width), length, tables, width, unit)


def probes_needed(model: Tables, queries: np.ndarray, found: np.ndarray, recall: float) -> list[tuple[int, ...]] | None:
    """The sets that a query must probe for ``recall`` of the pairs (query, true neighbour); None if there are too few."""
    sets = shift_sets(model.width, MOST_PROBES)
    first = np.full(len(queries), len(sets))
    step = max(1, nb.CHUNK_CELLS // (model.tables * len(sets)))
    for at in range(0, len(queries), step):
        met = model.probed(queries[at: at + step], sets) == model.own(found[at: at + step])[:, :, None]
        each = np.where(met.any(axis=2), met.argmax(axis=2), len(sets))
        first[at: at + step] = each.min(axis=1)
    need = int(np.sort(first)[math.ceil(recall * len(first)) - 1]) if len(first) else 0
    return sets[: need + 1] if need < len(sets) else None


def calibrated(
    queries: DataFrame, index: DataFrame, k: int, draw, width: int, recall: float, sample: int, unit: bool, **names,
) -> tuple[Tables, list[tuple[int, ...]]]:
    """The tables and the probes that reach the recall on the exact neighbours of a sample of queries; where no number of
    probes does, with fewer projections and so larger buckets."""
    query_id, query_vec, index_id, index_vec = (names[n] for n in ("query_id", "query_vec", "index_id", "index_vec"))
    asked = cut_lineage(queries.where(F.size(query_vec) > 0).orderBy(F.xxhash64(F.lit("lsh"), query_id)).limit(sample).select(
        query_id, F.col(query_vec).alias("_q")))
    truth = nb.knn(
        asked.withColumnRenamed("_q", query_vec).withColumn("_asked", F.col(query_vec)),
        index.select(index_id, index_vec, F.col(index_vec).alias("_met")), k,
        **{**names, "query_cols": ["_asked"], "index_cols": ["_met"]}).select("_asked", "_met").collect()  # sample * k rows
    pairs = [np.array([r[c] for r in truth], np.float64) for c in ("_asked", "_met")]
    if unit and truth:
        pairs = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in pairs]
    while True:
        model = draw(width)
        sets = probes_needed(model, *pairs, recall) if truth else shift_sets(width, 1)
        if sets is not None:
            return model, sets
        width -= 1


def knn_lsh(
    queries: DataFrame,
    index: DataFrame,
    k: int = 5,
    *,
    query_id: str = "q_id",
    query_vec: str = "q_vec",
    index_id: str = "c_id",
    index_vec: str = "c_vec",
    query_cols: Sequence[str] = (),
    index_cols: Sequence[str] = (),
    metric: str = "sql2",
    skip_self: bool = False,
    bucket_length: float | None = None,
    tables: int = 4,
    width: int | None = None,
    seed: int = 17,
    complete: bool = True,
    recall: float = RECALL,
    sample: int = SAMPLE,
    block_rows: int | None = None,
) -> DataFrame:
    """The k nearest index rows that lie in a bucket which the query probes in any hash table.

    With ``complete`` (the default) a query looks into its own buckets only, these bound the k-th distance, and the exact
    search finishes the job with fewer visits, so nothing is missed. Without it the result is approximate: true
    distances, but some neighbours may be missing. The number of probed buckets is then the one that finds ``recall`` of
    the exact neighbours of ``sample`` queries.

    By default a bucket is as long as a projection of the index typically spreads, and there are as many projections
    per table (``width``) as bring buckets of a spread-out index down to ``BUCKET_ROWS`` rows.
    """
    q = nb.usable(queries, query_id, query_cols, query_vec, "_qv", metric)
    c = nb.usable(index, index_id, index_cols, index_vec, "_cv", metric)
    first = c.select("_cv").first()
    names = dict(query_id=query_id, query_vec=query_vec, index_id=index_id, index_vec=index_vec,
                 query_cols=query_cols, index_cols=index_cols, metric=metric, skip_self=skip_self)
    if first is None:
        return nb.knn(queries, index, k, **names)
    dim, unit = len(first["_cv"]), metric == "cosine"
    rows = block_rows or max(1024, nb.BLOCK_BYTES // (8 * dim))

    if bucket_length is None or width is None:
        norm = F.sqrt(F.aggregate("_cv", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        size, mean = c.agg(F.count(F.lit(1)), F.lit(1.0) if unit else F.avg(norm)).first()
        if bucket_length is None:
            bucket_length = max(mean, 1e-9) / math.sqrt(dim)
        if width is None:
            width = max(1, math.ceil(math.log(max(1.0, size / BUCKET_ROWS)) / math.log(VALUES)))

    def draw(projections: int) -> Tables:
        return _drawn(dim, bucket_length, tables, projections, unit, seed)

    if complete:
        model, sets = draw(width), [()]
    else:
        model, sets = calibrated(queries, index, k, draw, width, recall, sample, unit, **names)
    keys = ["_table", "_bucket"]
    left, right = nb.deal_blocks(
        _scattered(q, "_qv", model, sets), _scattered(c, "_cv", model, None), keys, query_id, index_id, rows)
    found = nb.block_neighbours(
        left, right, [*keys, "_block", "_share"], k, query_id=query_id, index_id=index_id,
        query_cols=query_cols, index_cols=index_cols, metric=metric, within=None, skip_self=skip_self)
    # The same pair may come from several tables and then ranks once.
    order = Window.partitionBy(query_id).orderBy("distance", index_id)
    near = (
        found.withColumn("rank", F.dense_rank().over(order).cast("long"))
        .where(F.col("rank") <= k).dropDuplicates([query_id, index_id])
    )
    if not complete:
        return near
    scale = 2.0 if unit else 1.0
    bound = near.where(F.col("rank") == k).select(
        query_id, (F.sqrt(F.greatest(F.col("distance"), F.lit(0.0)) * scale) + nb.SLACK).alias("_bound"))
    bounded = cut_lineage(queries.join(bound, query_id, "left"))
    return nb.knn(
        bounded, index, k, **names, known_reach="_bound", block_rows=block_rows)


def recall_of(near: DataFrame, exact: DataFrame, query_id: str = "q_id", index_id: str = "c_id") -> DataFrame:
    """(neighbours, found, recall): how many of the exact neighbours an approximate search found."""
    hit = exact.select(query_id, index_id).join(
        near.select(query_id, index_id, F.lit(1).alias("hit")), [query_id, index_id], "left")
    return hit.agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found")).withColumn(
        "recall", F.col("found") / F.col("neighbours"))
