"""Clustering of integer vectors, with exact nearest centroids by progressive search over Walsh-Hadamard coefficients.

A vector and the centroids go through the unnormalised Walsh-Hadamard transform, which keeps squared distances up to the
factor of its size and integers integral. Coefficients are ordered by the number of sign changes of their row, coarse
to fine. A vector's search adds up squared differences block by block of coefficients: what has been added is a lower
bound of every centroid's distance. The centroid with the least coarse sum is finished first; its whole distance is an
upper bound, and a centroid whose sum gets strictly above it is out. Those left after all coefficients are compared,
ties going to the smaller number, so the result is that of a full search.

Vectors are transformed once and stored. A round broadcasts the centroids (at most `clusters` x `size` integers) and adds
up coefficients per centroid where the vectors are; as the transform is linear, sums of coefficients turn back into
sums of components without loss. Only one row per centroid reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import stored

CLUSTERS, SIZE, ROUNDS, SCALE = 16, 64, 3, 64
#: Components beyond this would let squared distances of coefficients leave 64 bits.
MOST = 1 << 22
#: Vectors that are searched at a time.
BLOCK = 4096


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in natural order; the number of columns is a power of two."""
    x, step = np.array(x, np.int64), 1
    shape = x.shape
    while step < shape[1]:
        pairs = x.reshape(shape[0], shape[1] // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2)
        step *= 2
    return x.reshape(shape)


def coarse_to_fine(size: int) -> np.ndarray:
    """Places of the coefficients by the number of sign changes of their rows."""
    return np.argsort((np.diff(transform(np.eye(size)), axis=1) != 0).sum(1), kind="stable")


def blocks(size: int) -> list[slice]:
    """An eighth of the coefficients first, then as many as there were so far."""
    ends = [0, max(1, size // 8)]
    while ends[-1] < size:
        ends.append(min(size, 2 * ends[-1]))
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance in coefficients) of each row of ordered coefficients."""
    every, first = np.arange(len(vectors)), blocks(vectors.shape[1])[0]
    total = ((vectors[:, None, first] - centroids[None, :, first]) ** 2).sum(2)
    whole = ((vectors - centroids[total.argmin(1)]) ** 2).sum(1)
    row, number = np.nonzero(total <= whole[:, None])
    at = total[row, number]
    for part in blocks(vectors.shape[1])[1:]:
        at = at + ((vectors[row, part] - centroids[number, part]) ** 2).sum(1)
        left = at <= whole[row]
        row, number, at = row[left], number[left], at[left]
    order = np.lexsort((number, at, row))
    chosen = order[np.searchsorted(row[order], every)]
    return number[chosen], at[chosen]


def integer_rows(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their components as integers): exactly `size` components, none null or not finite."""
    kept = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
    values = column.take(pa.array(kept)).flatten()
    x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # nulls turn into NaN
    with np.errstate(over="ignore"):
        x = np.floor(scale * x)
    fine = np.isfinite(x).all(1)
    kept, x = kept[fine], x[fine]
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"a component times {scale} is beyond {MOST}; scale the vectors down")
    return kept, x.astype(np.int64)


def coefficients(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(id, coefs) of the rows (id, vector) that are kept; coefficients are ordered coarse to fine."""
    order = coarse_to_fine(size)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = integer_rows(batch["vector"], size, scale)
            flat = pa.array(transform(x)[:, order].ravel())
            lists = pa.FixedSizeListArray.from_arrays(flat, size).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(kept)), lists], ["id", "coefs"])

    return rows.mapInArrow(of, f"id {dict(rows.dtypes)['id']}, coefs array<long>")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every row; distances are those of the components."""
    size = centroids.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                number, distance = nearest(matrix(part["coefs"], size), centroids)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(number.astype(np.int32)), pa.array(distance // size)],
                    ["id", "cluster", "distance"])

    return rows.mapInArrow(of, f"id {dict(rows.dtypes)['id']}, cluster int, distance long")


def sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Number of vectors and sum of their coefficients by nearest centroid. Sums are made per batch first."""
    size = centroids.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            x = matrix(batch["coefs"], size)
            for at in range(0, len(x), BLOCK):
                number = nearest(x[at: at + BLOCK], centroids)[0]
                np.add.at(total, number, x[at: at + BLOCK])
                n += np.bincount(number, minlength=len(n))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), size).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), lists],
                                             ["cluster", "n", "sums"])

    parts = rows.select("coefs").mapInArrow(of, "cluster int, n long, sums array<long>")
    # Decimals, so that no sum over any number of vectors overflows.
    whole = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)))
    return {r["cluster"]: (r["n"], np.array([int(r[f"s{i}"]) for i in range(size)], object)) for r in whole.collect() if r["n"]}


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
            size: int = SIZE, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(a stored row per kept vector: id, cluster, distance; the final centroids as integers).

    Kept are vectors of exactly `size` components (a power of two), none null or not finite; component x counts as
    floor(scale * x). Centroids start as the kept vectors of smallest SHA-256 of `1:<id>` in that order, equal hashes
    by their coefficients, null identifiers last; with fewer vectors than that there are fewer centroids. Each round
    assigns every vector to its nearest centroid (squared Euclidean distance, ties to the smaller number) and replaces
    centroids that have vectors by the floor of their mean; a last assignment follows. Repeated rows count each time and
    give a row each; copies of one vector of any number do no harm, as sums are made where they are. An empty table
    gives no rows and no centroids. Other columns aren't looked at. A component beyond 4,194,304 stops the job.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("vector"))
    rows = stored(coefficients(rows, size, scale), "coefficients")
    order = coarse_to_fine(size)
    digest = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    starts = rows.orderBy(digest.asc_nulls_last(), "coefs").limit(clusters).collect()
    centroids = np.array([r["coefs"] for r in starts], np.int64).reshape(-1, size)
    if len(centroids):
        for _ in range(rounds):
            for number, (n, total) in sums(rows, centroids).items():
                natural = np.zeros(size, object)
                natural[order] = total
                centroids[number] = transform([[int(x) // n for x in whole_components(natural)]])[0][order]
    back = np.zeros_like(centroids)
    back[:, order] = centroids
    found = assigned(rows, centroids) if len(centroids) else rows.selectExpr("id", "0 AS cluster", "0L AS distance")
    return stored(found, "clusters"), transform(back) // size


def whole_components(coefs: np.ndarray) -> np.ndarray:
    """The inverse transform of one row of Python integers in natural order, exact at any size."""
    x, step = list(coefs), 1
    while step < len(x):
        for at in range(0, len(x), 2 * step):
            for i in range(at, at + step):
                x[i], x[i + step] = x[i] + x[i + step], x[i] - x[i + step]
        step *= 2
    return np.array([v // len(x) for v in x], object)


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """A row per kept vector: id, cluster, distance, the distances' sums over its cluster and over all vectors, and the
    digest of its final centroid."""
    found, centroids = cluster(vectors, id_col, vector_col, **options)
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}

    def by_cluster(values: dict[int, object], kind: str) -> Column:
        out = F.lit(None)
        for number, value in values.items():
            out = F.when(F.col("cluster") == number, F.lit(value)).otherwise(out)
        return out.cast(kind)

    return found.select(
        F.col("id").alias(id_col), "cluster", "distance", by_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by_cluster({i: centroid_digest(c) for i, c in enumerate(centroids)}, "string").alias("centroid_sha256"))
