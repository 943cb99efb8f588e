"""Exact nearest neighbours between two tables of vectors.

The index is cut into cells around a bounded number of pivot vectors. Cells that lie near each other
travel as one bundle, up to a bounded size, and a cell beyond it is cut into blocks. From the cells'
sizes and radii each query gets an upper bound on its k-th distance, and travels, once per bundle, only
where a cell can hold something nearer (triangle inequality and separating hyperplane, so nothing is
lost). Query block meets index block in one cogroup, which works on matrices and gives back k rows per
query, never the pairs. A bundle or a query crowd of any size is split over as many blocks as it takes.
What a task holds at a time is bounded: blocks by bytes, distances by cells of their matrix, and rows
that it sends on by bytes. A block's vectors stay as they came; only tiles of them become float64.

Inputs are read several times (sizes, pivots, cells, result): pass stored or checkpointed tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 16 << 20
PIVOT_BYTES = 16 << 20
MAX_PIVOTS = 1024
#: Cells of a matrix that a task works on, and index rows of it.
CHUNK_CELLS = 1 << 19
TILE_ROWS = 2048
#: Bytes of rows that a task sends on in one batch.
SENT_BYTES = 4 << 20
BINS_PER_OCTAVE = 4
LOWEST_BIN = -40 * BINS_PER_OCTAVE
SLACK = 1e-6


def stored(column) -> np.ndarray:
    """Rows of an Arrow list column as one matrix: float32 as they are, others as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
    rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False))
    rows = rows if rows.dtype == np.float32 else rows.astype(np.float64, copy=False)
    return rows.reshape(len(column), -1) if len(column) else rows.reshape(0, 1)


def scaled(rows: np.ndarray, unit: bool) -> np.ndarray:
    """Rows as float64, scaled to length 1 if asked."""
    rows = rows.astype(np.float64, copy=False)
    if unit and rows.size:
        rows = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows


def matrix(column, unit: bool) -> np.ndarray:
    """Rows of an Arrow list column as one float64 matrix, scaled to length 1 if asked."""
    return scaled(stored(column), unit)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fast squared distances of all rows of two matrices, right up to rounding."""
    d = (-2.0 * a) @ b.T
    d += np.einsum("ij,ij->i", a, a)[:, None]
    d += np.einsum("ij,ij->i", b, b)
    return np.maximum(d, 0.0, out=d)


def exact_distances(a: np.ndarray, ai: np.ndarray, b: np.ndarray, bi: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows ai of a to rows bi of b, the same for equal rows wherever they stand."""
    step = max(1, CHUNK_CELLS // max(1, a.shape[1]))
    parts = []
    for i in range(0, len(ai), step):
        x, y = a[ai[i:i + step]], b[bi[i:i + step]]
        parts.append(((x - y) ** 2).sum(axis=1) if metric == "sql2" else 1.0 - (x * y).sum(axis=1))
    return np.concatenate(parts) if parts else np.zeros(0)


def sortable(ids: np.ndarray) -> np.ndarray:
    return np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids


def row_hashes(words: np.ndarray) -> np.ndarray:
    """One 64-bit number per row of 32-bit words, the same for equal rows."""
    factors = np.random.default_rng(1).integers(1, 1 << 63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = np.empty(len(words), np.uint64)
    for i in range(0, len(words), TILE_ROWS):
        hashes[i:i + TILE_ROWS] = words[i:i + TILE_ROWS].astype(np.uint64) @ factors
    return hashes


def row_groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row number per distinct row, the group of each row), by bits. Hashes bring equal rows together and the
    rows themselves decide; no copy of all of them is sorted."""
    words = np.ascontiguousarray(rows).view(np.uint32)
    _, first, group = np.unique(row_hashes(words), return_index=True, return_inverse=True)
    if len(first) == len(rows):
        return np.arange(len(rows)), np.arange(len(rows))
    copies = np.nonzero(first[group] != np.arange(len(rows)))[0]
    for i in range(0, len(copies), TILE_ROWS):
        some = copies[i:i + TILE_ROWS]
        if (words[some] != words[first[group[some]]]).any():  # two rows of one hash
            _, first, group = np.unique(words, axis=0, return_index=True, return_inverse=True)
            return first, group.ravel()
    return first, group


def place_in_run(keys: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal keys, for sorted keys."""
    return np.arange(len(keys)) - np.searchsorted(keys, keys, side="left")


def useful_copies(rows: np.ndarray, order_ids: np.ndarray, wanted: int) -> np.ndarray:
    """Row numbers without the copies that cannot be among the nearest of anything: of equal rows
    only the ``wanted`` lowest ids can."""
    first, group = row_groups(rows)
    if len(first) == len(rows):
        return first
    order = np.lexsort((order_ids, group))
    return np.sort(order[place_in_run(group[order]) < wanted])


def nearest_rows(
    queries: np.ndarray, candidates: np.ndarray, query_ids: np.ndarray, candidate_ids: np.ndarray,
    k: int, metric: str, within: float | None, skip_self: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, distance, rank) of the k nearest candidates per query row.

    A fast product picks everything that may be among the nearest, with room for rounding;
    those distances are then taken exactly, and ties go to the lower id. Equal queries are
    answered once, and copies of a candidate count only as far as they can rank. Rows come as
    they are stored, and only a tile of either side is held as float64.
    """
    if not len(queries) or not len(candidates):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    wanted = k + 1 if skip_self else k
    order_ids = sortable(candidate_ids)
    kept = useful_copies(candidates, order_ids, wanted)
    first, group = row_groups(queries)
    ui, ci, d = _nearest(queries, first, candidates, kept, order_ids, wanted, metric, within)

    sizes = np.bincount(ui, minlength=len(first))
    times = sizes[group]
    qi = np.repeat(np.arange(len(queries)), times)
    starts = (np.cumsum(sizes) - sizes)[group]
    at = np.repeat(starts, times) + place_in_run(qi)
    ci, d = ci[at], d[at]
    if skip_self:
        other = query_ids[qi] != candidate_ids[ci]
        qi, ci, d = qi[other], ci[other], d[other]
    rank = place_in_run(qi)
    top = rank < k
    return qi[top], ci[top], d[top], rank[top] + 1


def _nearest(queries, asked, candidates, kept, order_ids, wanted: int, metric: str, within: float | None):
    """(place in ``asked``, candidate row, distance) of the nearest of the ``kept`` candidates, tile by tile."""
    unit = metric == "cosine"
    wide = 2.0 if unit else 1.0  # of a distance to a squared one
    step = max(1, CHUNK_CELLS // min(len(kept), TILE_ROWS))
    found = []
    for i in range(0, len(asked), step):
        block = scaled(queries[asked[i:i + step]], unit)
        double, own = -2.0 * block, np.einsum("ij,ij->i", block, block)
        reach = np.full(len(block), np.inf if within is None else wide * within)
        qi, ci, exact = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for j in range(0, len(kept), TILE_ROWS):
            rows = kept[j:j + TILE_ROWS]
            tile = scaled(candidates[rows], unit)
            norms = np.einsum("ij,ij->i", tile, tile)
            room = SLACK * (1.0 + 2.0 * (np.fmax.reduce(own) + np.fmax.reduce(norms)))
            d = double @ tile.T
            d += norms
            if j == 0 and wanted < len(rows):  # some of the first tile bound the wanted distance of all
                some = d[:, ::max(1, min(16, len(rows) // (64 * wanted)))]
                reach = np.fmin(reach, np.partition(some, wanted - 1, axis=1)[:, wanted - 1] + own)
            ti, tj = np.nonzero(d <= (reach + room - own)[:, None])
            if not len(ti):
                continue
            near = exact_distances(block, ti, tile, tj, metric)
            if within is not None:
                ti, tj, near = ti[near < within], tj[near < within], near[near < within]
            qi, ci, exact = np.concatenate([qi, ti]), np.concatenate([ci, rows[tj]]), np.concatenate([exact, near])
            order = np.lexsort((order_ids[ci], exact, qi))
            order = order[place_in_run(qi[order]) < wanted]
            qi, ci, exact = qi[order], ci[order], exact[order]
            sizes = np.bincount(qi, minlength=len(block))
            full = sizes == wanted
            reach[full] = np.fmin(reach[full], wide * exact[(np.cumsum(sizes) - 1)[full]])
        found.append((qi + i, ci, exact))
    return tuple(np.concatenate(parts) for parts in zip(*found))


@dataclass
class Cells:
    """Bounded summary of an index: pivots, and per cell its size, radii and nearest members. ``bundle`` has the
    bundle of each cell, ``blocks`` the blocks of each bundle, ``order`` the cells bundle after bundle."""

    pivots: np.ndarray
    sizes: np.ndarray
    bundle: np.ndarray
    blocks: np.ndarray
    order: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    bin_cell: np.ndarray
    bin_edge: np.ndarray
    bin_count: np.ndarray
    between: np.ndarray = field(default=None)

    def __post_init__(self):
        self.between = np.sqrt(squared_distances(self.pivots, self.pivots))

    def reach(self, to_pivot: np.ndarray, k: int) -> np.ndarray:
        """Upper bound on the k-th distance of each query."""
        bound = to_pivot[:, self.bin_cell] + self.bin_edge[None, :]
        order = np.argsort(bound, axis=1)
        enough = np.cumsum(self.bin_count[order], axis=1) >= k
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
        rows = np.arange(len(bound))
        value = bound[rows, order[rows, at]]
        return np.where(enough.any(axis=1), value, np.inf)

    def candidates(self, vectors: np.ndarray, k: int, radius: float | None, known: np.ndarray) -> np.ndarray:
        """Which bundles each query must visit, as a boolean matrix. ``known`` holds bounds on the
        k-th distance that are known beforehand, or infinity."""
        to_pivot = np.sqrt(squared_distances(vectors, self.pivots))
        reach = np.minimum(self.reach(to_pivot, k), known)
        if radius is not None:
            reach = np.minimum(reach, radius)
        home = to_pivot.argmin(axis=1)
        near = to_pivot[np.arange(len(vectors)), home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (to_pivot ** 2 - near[:, None] ** 2) / (2.0 * self.between[home])
        plane = np.where(self.between[home] > SLACK, plane, 0.0)
        least = np.maximum(np.maximum(to_pivot - self.outer, self.inner - to_pivot), plane)
        room = SLACK * (1.0 + to_pivot.max(initial=0.0))
        cells = (least <= reach[:, None] + room) & (self.sizes > 0)[None, :]
        starts = np.searchsorted(self.bundle[self.order], np.arange(len(self.blocks)))
        return np.logical_or.reduceat(cells[:, self.order], starts, axis=1)


def _bin(distance: Column) -> Column:
    return F.greatest(
        F.floor(F.log2(F.greatest(distance, F.lit(1e-300))) * BINS_PER_OCTAVE), F.lit(LOWEST_BIN))


def _edge(bins: np.ndarray) -> np.ndarray:
    return 2.0 ** ((bins + 2.0) / BINS_PER_OCTAVE)


def homes(vectors, pivots: np.ndarray, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, distance to it) of each row of an Arrow list column."""
    rows = stored(vectors)
    cell, near = np.zeros(len(rows), np.int32), np.zeros(len(rows))
    step = max(1, CHUNK_CELLS // len(pivots))
    for i in range(0, len(rows), step):
        d = squared_distances(scaled(rows[i:i + step], unit), pivots)
        cell[i:i + step] = d.argmin(axis=1)
        near[i:i + step] = np.sqrt(d.min(axis=1))
    return cell, near


def _assign(vec: str, pivots: np.ndarray, unit: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in homes(batch.column(vec), pivots, unit)], names=["_cell", "_to_pivot"])

    return run


def bundles(pivots: np.ndarray, sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bundle of each cell, blocks of each bundle, cells bundle after bundle): cells go from pivot to nearest
    pivot into bundles of at most ``rows`` rows; one with more is a bundle of several blocks."""
    left, at, order = np.ones(len(pivots), bool), 0, []
    for _ in range(len(pivots)):
        order.append(at)
        left[at] = False
        away = squared_distances(pivots[at:at + 1], pivots)[0]
        at = int(np.where(left, away, np.inf).argmin())
    bundle, held = np.zeros(len(pivots), np.int64), [0]
    for cell in order:
        if held[-1] and held[-1] + sizes[cell] > rows:
            held.append(0)
        bundle[cell] = len(held) - 1
        held[-1] += sizes[cell]
    return bundle, np.maximum(1, -(-np.array(held) // rows)), np.array(order)


def _summarise(assigned: DataFrame, pivots: np.ndarray, bundle_rows: int, k: int) -> Cells:
    rows = (
        assigned.groupBy("_cell", _bin(F.col("_to_pivot")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_to_pivot").alias("lo"), F.max("_to_pivot").alias("hi"))
        .collect()
    )
    m = len(pivots)
    sizes, inner, outer = np.zeros(m, np.int64), np.full(m, np.inf), np.zeros(m)
    bins: dict[int, list] = {}
    for r in rows:
        sizes[r["_cell"]] += r["n"]
        inner[r["_cell"]] = min(inner[r["_cell"]], r["lo"])
        outer[r["_cell"]] = max(outer[r["_cell"]], r["hi"])
        bins.setdefault(r["_cell"], []).append((r["bin"], r["n"]))
    kept = []
    for cell, members in bins.items():
        seen = 0
        for b, n in sorted(members):
            kept.append((cell, b, n))
            seen += n
            if seen >= k:
                break
    cell, b, n = (np.array(x) for x in zip(*kept))
    bundle, blocks, order = bundles(pivots, sizes, bundle_rows)
    return Cells(
        pivots=pivots, sizes=sizes, bundle=bundle, blocks=blocks, order=order,
        inner=np.where(sizes > 0, inner, 0.0), outer=outer,
        bin_cell=cell, bin_edge=_edge(b.astype(float)), bin_count=n,
    )


def _visit_counts(vec: str, cells: Cells, k: int, radius: float | None, unit: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells.blocks), np.int64)
        for batch in batches:
            for _, chosen in _chosen_cells(batch, vec, cells, k, radius, unit):
                total += chosen.sum(axis=0)
        cell = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["_cell", "n"])

    return run


def _chosen_cells(batch, vec, cells, k, radius, unit):
    vectors = matrix(batch.column(vec), unit)
    known = batch.column("_known").to_numpy(zero_copy_only=False)
    step = max(1, CHUNK_CELLS // max(1, len(cells.pivots) + len(cells.bin_cell), int(cells.blocks.sum())))
    for i in range(0, len(vectors), step):
        yield i, cells.candidates(vectors[i:i + step], k, radius, known[i:i + step])


def _spread_queries(vec, cells: Cells, shares: np.ndarray, k, radius, unit) -> Callable:
    """Send each query to every block of the bundles it must visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("_hash").to_numpy(zero_copy_only=False)
            for start, chosen in _chosen_cells(batch, vec, cells, k, radius, unit):
                row, cell = np.nonzero(chosen)
                times = cells.blocks[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                ends = np.cumsum(times)
                block = np.arange(len(row)) - np.repeat(ends - times, times)
                share = np.mod(hashes[start + row], shares[cell])
                yield from _tagged(batch, start + row, cell, block, share)

    return run


def _spread_index(vec: str, cells: Cells, shares: np.ndarray, unit: bool) -> Callable:
    """Put each index row in one block of its cell's bundle, once per share of the bundle's queries."""
    rows = max(1, CHUNK_CELLS // int(shares.max()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, _ = homes(batch.column(vec), cells.pivots, unit)
            hashes = batch.column("_hash").to_numpy(zero_copy_only=False)
            for at in range(0, len(home), rows):
                cell = cells.bundle[home[at:at + rows]]
                block = np.mod(hashes[at:at + rows], cells.blocks[cell])
                times = shares[cell]
                row = np.repeat(np.arange(len(cell)), times)
                ends = np.cumsum(times)
                share = np.arange(len(row)) - np.repeat(ends - times, times)
                yield from _tagged(batch, at + row, cell[row], block[row], share)

    return run


def copies(batch: pa.RecordBatch, row: np.ndarray, tags: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The given rows of a batch, each as often as it is given, beside its tags; in batches of bounded bytes."""
    step = max(1, SENT_BYTES * batch.num_rows // max(1, batch.nbytes))
    for at in range(0, len(row), step):
        taken = batch.take(pa.array(row[at:at + step]))
        beside = [pa.array(x[at:at + step]) for x in tags.values()]
        yield pa.RecordBatch.from_arrays([*taken.columns, *beside], names=[*batch.schema.names, *tags])


def _tagged(batch, row, cell, block, share) -> Iterator[pa.RecordBatch]:
    sent = batch.select([n for n in batch.schema.names if n not in _HELPERS])
    tags = {n: np.asarray(x).astype(np.int32) for n, x in zip(_TAGS, (cell, block, share))}
    return copies(sent, row, tags)


def _with_fields(schema: T.StructType, drop: Sequence[str] = (), **added: T.DataType) -> T.StructType:
    kept = [f for f in schema.fields if f.name not in drop]
    return T.StructType([*kept, *[T.StructField(n, t) for n, t in added.items()]])


_HELPERS = ("_hash", "_known")
_TAGS = {"_cell": T.IntegerType(), "_block": T.IntegerType(), "_share": T.IntegerType()}


def block_neighbours(
    queries: DataFrame, index: DataFrame, keys: Sequence[str], k: int, *, query_id: str, index_id: str,
    query_cols: Sequence[str], index_cols: Sequence[str], metric: str, within: float | None, skip_self: bool,
) -> DataFrame:
    """k nearest inside each pair of blocks that share ``keys``; vectors are in _qv and _cv."""
    left, right = [query_id, *query_cols], [index_id, *index_cols]
    schema = T.StructType([
        *[queries.schema[c] for c in left], *[index.schema[c] for c in right],
        T.StructField("distance", T.DoubleType()), T.StructField("rank", T.LongType()),
    ])

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        qi, ci, d, rank = nearest_rows(
            stored(q.column("_qv")) if q.num_rows and c.num_rows else np.zeros((0, 1)),
            stored(c.column("_cv")) if q.num_rows and c.num_rows else np.zeros((0, 1)),
            q.column(query_id).to_numpy(), c.column(index_id).to_numpy(), k, metric, within, skip_self,
        )
        ours, theirs = q.select(left).take(pa.array(qi)), c.select(right).take(pa.array(ci))
        columns = [*ours.columns, *theirs.columns, pa.array(d), pa.array(rank.astype(np.int64))]
        return pa.table(columns, names=schema.names)

    return queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(run, schema)


def keep_nearest(found: DataFrame, query_id: str, index_id: str, k: int) -> DataFrame:
    """Merge the few best of each block into the k best of each query."""
    order = Window.partitionBy(query_id).orderBy("distance", index_id)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def usable(df: DataFrame, id_col: str, cols: Sequence[str], vec: str, name: str, metric: str) -> DataFrame:
    """Rows with a vector; the cosine metric is undefined for an all-zero one."""
    rows = df.select(id_col, *cols, F.col(vec).alias(name)).where(F.size(name) > 0)
    return rows.where(F.exists(name, lambda x: x != 0)) if metric == "cosine" else rows


def default_block_rows(rows: DataFrame, vec: str) -> int:
    """Vectors that a block holds."""
    sample = rows.select(vec).first()
    return max(1024, BLOCK_BYTES // (8 * len(sample[vec]))) if sample else 1024


def deal_blocks(
    queries: DataFrame, index: DataFrame, keys: Sequence[str], query_id: str, index_id: str, rows: int,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with _block and _share, on which, beside the keys, they meet: the index rows of a key are dealt into
    blocks and its queries into shares, of about ``rows`` each; a share goes to all blocks of its own key."""

    def parts(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
        return counts.select(*keys, F.ceil(F.col("n") / rows).cast("int").alias(name))

    blocks, shares = parts(index, "_blocks"), parts(queries, "_shares")

    def split(df: DataFrame, own: str, own_name: str, other: str, other_name: str, id_col: str) -> DataFrame:
        sized = df.join(blocks, list(keys), "left").join(shares, list(keys), "left")
        mine = F.pmod(F.xxhash64(id_col), F.coalesce(own, F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return sized.withColumn(own_name, mine).withColumn(other_name, copies).drop("_blocks", "_shares")

    return (split(queries, "_shares", "_share", "_blocks", "_block", query_id),
            split(index, "_blocks", "_block", "_shares", "_share", index_id))


def knn(
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
    within: float | None = None,
    skip_self: bool = False,
    block_rows: int | None = None,
    known_reach: str | None = None,
    bundle_rows: int | None = None,
) -> DataFrame:
    """The k nearest index rows of each query: (query, index row, distance, rank from 1).

    ``metric`` is "sql2" (squared Euclidean) or "cosine" (1 - cosine). ``within`` keeps only
    neighbours nearer than that. ``query_cols`` and ``index_cols`` are carried along.
    ``known_reach`` names a query column with an upper bound on the k-th Euclidean distance
    (between unit vectors for "cosine"), where one is known; it only saves visits. ``block_rows`` is
    the size of an index that is cut into cells, and sets their number; rows travel in blocks of
    ``bundle_rows``, by default as many as ``BLOCK_BYTES`` hold.
    """
    if metric not in ("sql2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    unit = metric == "cosine"
    reach = F.coalesce(F.col(known_reach) if known_reach else F.lit(None), F.lit(math.inf)).cast("double")
    q = usable(
        queries.withColumn("_known", reach), query_id, [*query_cols, "_known"], query_vec, "_qv", metric)
    c = usable(index, index_id, index_cols, index_vec, "_cv", metric)
    names = dict(query_id=query_id, index_id=index_id, query_cols=query_cols, index_cols=index_cols)
    options = dict(metric=metric, within=within, skip_self=skip_self)

    sample = c.select("_cv").first()
    if sample is None:
        keys = [F.lit(0).alias(t) for t in _TAGS]
        return block_neighbours(
            q.select("*", *keys), c.select("*", *keys), list(_TAGS), k, **names, **options)
    dim = len(sample["_cv"])
    most_rows = max(1024, BLOCK_BYTES // (8 * dim))
    block_rows = block_rows or most_rows
    bundle_rows = bundle_rows or max(block_rows, most_rows)
    wanted = k + 1 if skip_self else k
    size = c.count()

    if size <= block_rows:
        share = _shares(q.count(), block_rows, q)
        one = q.select(
            "*", F.lit(0).alias("_cell"), F.lit(0).alias("_block"),
            F.pmod(F.xxhash64(query_id), F.lit(share)).cast("int").alias("_share"))
        other = c.select(
            "*", F.lit(0).alias("_cell"), F.lit(0).alias("_block"),
            F.explode(F.sequence(F.lit(0), F.lit(share - 1))).alias("_share"))
        return block_neighbours(one, other, list(_TAGS), k, **names, **options)

    most = max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * dim)))
    count = min(most, -(-4 * size // block_rows))
    drawn = c.select("_cv").orderBy(F.xxhash64(index_id)).limit(count).collect()
    pivots = np.unique(np.array([r["_cv"] for r in drawn], dtype=np.float64), axis=0)
    if unit:
        pivots = pivots / np.sqrt((pivots * pivots).sum(axis=1, keepdims=True))

    c = c.withColumn("_hash", F.xxhash64(index_id, F.lit(1)))
    q = q.withColumn("_hash", F.xxhash64(query_id, F.lit(2)))
    assigned = c.mapInArrow(_assign("_cv", pivots, unit), "_cell int, _to_pivot double")
    cells = _summarise(assigned, pivots, bundle_rows, wanted)
    radius = None if within is None else math.sqrt(max(within, 0.0) * (2.0 if unit else 1.0))
    counts = (
        q.mapInArrow(_visit_counts("_qv", cells, wanted, radius, unit), "_cell int, n long")
        .groupBy("_cell").agg(F.sum("n").alias("n")).collect()
    )
    shares = np.ones(len(cells.blocks), np.int64)
    cores = c.sparkSession.sparkContext.defaultParallelism
    for r in counts:  # bounded, and enough of them for all cores
        enough = min(-(-2 * cores // int(cells.blocks.sum())), -(-r["n"] // 256))
        shares[r["_cell"]] = max(-(-r["n"] // bundle_rows), enough)
    spread_q = q.mapInArrow(
        _spread_queries("_qv", cells, shares, wanted, radius, unit), _with_fields(q.schema, _HELPERS, **_TAGS))
    spread_c = c.mapInArrow(  # in one step with finding its cell, so a task needs one Python worker
        _spread_index("_cv", cells, shares, unit), _with_fields(c.schema, _HELPERS, **_TAGS))
    found = block_neighbours(spread_q, spread_c, list(_TAGS), k, **names, **options)
    return keep_nearest(found, query_id, index_id, k)


def _shares(queries: int, block_rows: int, df: DataFrame) -> int:
    """Enough query shares for bounded blocks, and for all cores when there is work for them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-queries // block_rows), min(cores, -(-queries // 256)))
