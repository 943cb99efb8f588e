"""Removal of repeated passages, over a de Bruijn graph of words.

The edges of the graph are windows of `window` consecutive words, the nodes what two successive windows share. A window
whose words also start earlier (in a smaller document, or earlier in the same one) is a repeated edge, and it knows the
coordinates of an earlier start, its source. Walking a document along repeated edges, a path goes on without branching
as long as the source goes on too, word by word; such paths compact to spans, one row each. A span is verified by
digesting its words and the words at its source's coordinates, which must agree, and then cut out.

Few windows repeat, so most never become rows. Each window has an anchor, its smallest-hashed run of `anchor` words;
equal windows have equal anchors, and neighbours mostly share theirs, so there is about one per seven words. Only
windows whose anchor occurs at two different places become edges. Documents with the same words count once for this:
all but the first of them are removed whole, unless shorter than a window.

Hot passages: of anchors and windows that repeat within a batch of rows, each batch shuffles a bounded number of
rows; the others are known to repeat already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.common import discard, look_up, shuffle_partitions, store, stored, text_of

WINDOW = 20
ANCHOR = 6
#: Bytes of text that are hashed at a time.
SEGMENT = 1 << 21
#: Places of one anchor that a batch gives to the shuffle; of more than that, two and the word that they repeat.
FEW = 4
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, n.bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = (both[0], both[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], each as if it started at 0."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(whole: bytes) -> np.ndarray:
    """A hash per word of a text whose words are joined by single spaces."""
    found, at = [], 0
    while at < len(whole):
        end = whole.find(b" ", at + SEGMENT)
        end = len(whole) if end < 0 else end
        part = np.frombuffer(whole, np.uint8, end - at, at)
        gaps = np.flatnonzero(part == 32)
        starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(part)]
        found.append(mixed(sums(part.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_BASE)))
        at = end + 1
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def runs(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash per run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    starts = np.arange(len(words) - n + 1)
    return mixed(sums(words, starts, starts + n, base))


def anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of anchor words, and for each window the place of its smallest (the first, if they tie)."""
    hashes = runs(words, anchor, WORD_BASES[0])
    span = window - anchor + 1
    if len(hashes) < span:
        return hashes, np.zeros(0, np.int64)
    return hashes, np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(1) + np.arange(len(hashes) - span + 1)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows, cut only between different keys."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_arrays(batch.columns, batch.schema.names)
        if not rows.num_rows:
            continue
        last = [rows[k].to_numpy() for k in keys]
        end = int(np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in last]))[-1:].sum() + 1) if any(
            c[0] != c[-1] for c in last) else 0
        if end or (held and any(held[0][k][0] != rows[k][0] for k in keys)):
            yield pa.concat_tables([*held, rows.slice(0, end)]).combine_chunks()
            held = []
        held.append(rows.slice(end))
    if held:
        yield pa.concat_tables(held).combine_chunks()


class Passages:
    """The steps, for documents whose identifiers are of one type."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int):
        if not 1 <= anchor <= window:
            raise ValueError("an anchor has 1 to `window` words")
        self.window, self.anchor = window, anchor
        text = text_of(docs[text_col])
        self.docs = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("xt"), text.cast("binary").alias("text"))
        self.kind = dict(self.docs.dtypes)["doc_id"]
        self.partitions = shuffle_partitions(docs.sparkSession)

    def read(self) -> DataFrame:
        """A row per document: n_words, the digest of its words, and the hashes and places of its anchors."""
        window, anchor = self.window, self.anchor

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, digest, hashes, places, sizes = [], [], [], [], [0]
                for text in batch["text"].to_pylist():
                    words = text.split()
                    whole = b" ".join(words)
                    found, mine = anchors(word_hashes(whole), window, anchor)
                    mine = np.unique(mine)
                    n_words.append(len(words))
                    digest.append(hashlib.sha256(whole).digest())
                    hashes.append(found[mine])
                    places.append(mine)
                    sizes.append(len(mine))
                at = pa.array(np.cumsum(sizes), pa.int32())
                flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
                flat_at = np.concatenate(places) if places else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"], batch["xt"], batch["slot"], pa.array(n_words, pa.int64()),
                    pa.array(digest, pa.binary()), pa.ListArray.from_arrays(at, signed(flat)),
                    pa.ListArray.from_arrays(at, pa.array(flat_at.astype(np.int32)))],
                    ["doc_id", "xt", "slot", "n_words", "digest", "anchors", "places"])

        rows = self.docs.select("*", F.spark_partition_id().alias("slot"))
        return rows.mapInArrow(of, f"doc_id {self.kind}, xt long, slot int, n_words long, digest binary, "
                                   "anchors array<long>, places array<int>")

    def repeated_anchors(self, read: DataFrame) -> DataFrame:
        """(same, place): places of anchors that other texts, or the same text at another place, also have. `same`
        is a hash of a text's words."""
        few = FEW

        def local(batches: Iterator[pa.RecordBatch], known: bool) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch["anchors"]
                sizes = lists.value_lengths().to_numpy()
                same = np.repeat(batch["same"].to_numpy(), sizes)
                anchor, place = lists.flatten().to_numpy(), batch["places"].flatten().to_numpy()
                order = np.lexsort((place, same, anchor))
                anchor, same, place = anchor[order], same[order], place[order]
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (same[1:] != same[:-1]) | (place[1:] != place[:-1])]
                anchor, same, place = (x[new[: len(x)]] for x in (anchor, same, place))
                starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)])
                number = np.diff(np.r_[starts, len(anchor)])
                many = np.repeat(number > few, number)
                ends = np.zeros(len(anchor), bool)
                ends[starts] = True
                ends[starts + number - 1] = True
                chosen = many if known else ~many | ends
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[chosen]) for x in (anchor, same, place)], ["anchor", "same", "place"])

        def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in whole_groups(batches, ["anchor"]):
                anchor, same, place = (rows[c].to_numpy() for c in ("anchor", "same", "place"))
                starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                ends = np.r_[starts[1:], len(anchor)] - 1
                several = (same[starts] != same[ends]) | (place[starts] != place[ends])
                chosen = np.repeat(several, ends - starts + 1)
                yield pa.RecordBatch.from_arrays([pa.array(same[chosen]), pa.array(place[chosen])], ["same", "place"])

        rows = read.filter(F.size("anchors") > 0).select(self.same(), "anchors", "places")
        kind = "anchor long, same long, place int"
        met = rows.mapInArrow(lambda x: local(x, False), kind).repartition(self.partitions, "anchor")
        met = met.sortWithinPartitions("anchor", "same", "place").mapInArrow(repeated, "same long, place int")
        return met.unionByName(rows.mapInArrow(lambda x: local(x, True), kind).select("same", "place"))

    @staticmethod
    def same() -> Column:
        return F.xxhash64("digest").alias("same")

    def edges(self, marked: DataFrame) -> DataFrame:
        """Windows of marked documents whose anchor repeats: 96 bits of hash and coordinates. Of windows that are equal
        within a batch only the earliest is left open; the others have its coordinates as their source."""
        window, anchor = self.window, self.anchor

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number, a, b, n, start = batch["n"].to_numpy(), [], [], [], []
                texts, places = batch["text"], batch["places"]
                for i in np.unique(number, return_index=True)[1].tolist():
                    words = word_hashes(b" ".join(texts[i].as_py().split()))
                    at = np.flatnonzero(np.isin(anchors(words, window, anchor)[1], places[i].values.to_numpy()))
                    a.append(runs(words, window, WORD_BASES[0])[at])
                    b.append(runs(words, window, WORD_BASES[1])[at].view(np.int64) >> 32)
                    n.append(np.full(len(at), number[i]))
                    start.append(at)
                if not n:
                    continue
                a, b, n, start = map(np.concatenate, (a, b, n, start))
                order = np.lexsort((np.arange(len(a)), b, a))
                a, b, n, start = a[order], b[order], n[order], start[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
                first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(a) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    signed(a), pa.array(b.astype(np.int32)), pa.array(n), pa.array(start.astype(np.int32)),
                    pa.array(n[first], mask=new), pa.array(start[first].astype(np.int32), mask=new)],
                    ["a", "b", "n", "start", "src_n", "src_start"])

        return marked.mapInArrow(of, "a long, b int, n long, start int, src_n long, src_start int")

    def repeated_edges(self, edges: DataFrame) -> DataFrame:
        """Windows that start earlier too, with the coordinates of an earlier start as source. Those that have their
        source are dealt out by their coordinates and just pass."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["n", "start", "src_n", "src_start"]
            for rows in whole_groups(batches, ["key"]):
                known = pc.is_valid(rows["src_n"])
                yield from rows.filter(known).select(names).to_batches()
                rows = rows.filter(pc.invert(known))
                if not rows.num_rows:
                    continue
                a, b, n, start = (rows[c].to_numpy() for c in ("key", "b", "n", "start"))
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                other = (n != n[first]) | (start != start[first])  # a repeated row isn't its own copy
                first = first[other]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (n[other], start[other], n[first], start[first])], names)

        key = F.when(F.col("src_n").isNull(), F.col("a")).otherwise(F.xxhash64("n", "start"))
        met = edges.select(key.alias("key"), "b", "n", "start", "src_n", "src_start").repartition(self.partitions, "key")
        return met.sortWithinPartitions("key", "b", "n", "start").mapInArrow(
            of, "n long, start int, src_n long, src_start int")

    def spans(self, repeated: DataFrame) -> DataFrame:
        """Paths of repeated edges that don't branch, as spans: start and number of words, and their source."""
        order = Window.partitionBy("n").orderBy("start")
        on = ((F.lag("start").over(order) == F.col("start") - 1) & (F.lag("src_n").over(order) == F.col("src_n"))
              & (F.lag("src_start").over(order) == F.col("src_start") - 1))
        # Repeated rows of a document give a window several times; it needs one source only.
        repeated = repeated.groupBy("n", "start").agg(F.min(F.struct("src_n", "src_start")).alias("src")).select(
            "n", "start", "src.*")
        path = repeated.withColumn("new", F.when(on, 0).otherwise(1)).withColumn(
            "path", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return path.groupBy("n", "path", "src_n").agg(
            F.min("start").alias("start"), F.min("src_start").alias("src_start"),
            (F.count("*") + self.window - 1).alias("words")).drop("path")

    def cut(self, marked: DataFrame, spans: DataFrame) -> DataFrame:
        """Two kinds of rows: documents with what is left of them (n_removed, kept), and for every span, and for the
        source of every span, the digest of its words, under the source's coordinates (at_n, at_start, words)."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([
                ("n", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("at_n", pa.int64()),
                ("at_start", pa.int32()), ("words", pa.int64()), ("digest", pa.binary())])
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    words = row["text"].split()
                    gone = np.zeros(len(words), bool)
                    for ask in row["asks"]:
                        part = slice(ask["start"], ask["start"] + ask["words"])
                        if ask["own"]:
                            gone[part] = True
                        out.append((None, None, None, ask["at_n"], ask["at_start"], ask["words"],
                                    hashlib.sha256(b" ".join(words[part])).digest()))
                    kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                    out.append((row["n"], int(gone.sum()), hashlib.sha256(kept).digest(), *[None] * 4))
                columns = list(zip(*out, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        source = [F.col("src_n").alias("at_n"), F.col("src_start").alias("at_start")]
        own = spans.select("n", F.lit(True).alias("own"), "start", "words", *source)
        theirs = spans.select(F.col("src_n").alias("n"), F.lit(False).alias("own"), F.col("src_start").alias("start"),
                              "words", *source).distinct()
        asks = own.unionByName(theirs).groupBy("n").agg(
            F.collect_list(F.struct("own", "start", "words", "at_n", "at_start")).alias("asks"))
        return marked.select("n", "text").join(asks, "n").mapInArrow(
            of, "n long, n_removed long, kept binary, at_n long, at_start int, words long, digest binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_digest (SHA-256 of the kept words, joined by spaces).

    A word goes if a window that covers it also starts earlier: in a smaller doc_id, or earlier in the document. Windows
    are judged on the input. Null texts have no words; texts shorter than a window lose nothing. Null identifiers come
    last. Rows that repeat in identifier and text are one document, and give equal rows; rows that share the identifier
    only are ordered by a hash of their texts. An empty table gives no rows; other columns aren't looked at.
    """
    job, spark = Passages(docs, id_col, text_col, window, anchor), docs.sparkSession
    read_path = store(reading := job.read(), "read")
    read = spark.read.schema(reading.schema).parquet(read_path)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "xt")).alias("first")
    firsts = read.groupBy("digest").agg(first)
    rows = stored(look_up(read.drop("anchors", "places"), firsts, ["digest"]).select(
        "doc_id", "xt", "n_words", "digest", job.same(),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("xt") == F.col("first.xt"))).alias("is_first"),
    ), "firsts")
    # Numbers in the order of documents: partitions are ranges, and rows within them are sorted.
    order = [F.col("doc_id").asc_nulls_last(), F.col("xt").asc()]
    numbered = rows.filter("is_first").select("doc_id", "xt", "same").distinct()
    numbered = numbered.repartitionByRange(job.partitions, *order).sortWithinPartitions(*order)
    numbered = stored(numbered.withColumn("n", F.monotonically_increasing_id()), "numbered")
    places = stored(job.repeated_anchors(read).groupBy("same").agg(F.collect_set("place").alias("places")), "places")
    discard(spark, read_path)
    names = numbered.select(F.col("doc_id").alias("_id"), F.col("xt").alias("_xt"), "n", "same").join(places, "same")
    marked = job.docs.join(names, job.docs["doc_id"].eqNullSafe(names["_id"]) & (job.docs["xt"] == names["_xt"]))
    marked_path = store(marking := marked.select("n", "text", "places"), "marked")
    marked = spark.read.schema(marking.schema).parquet(marked_path)
    spans = stored(job.spans(job.repeated_edges(job.edges(marked))), "spans")
    cut = stored(job.cut(marked, spans), "cut")
    discard(spark, marked_path)
    same = cut.filter("digest is not null").groupBy("at_n", "at_start", "words").agg(
        F.min("digest").alias("least"), F.max("digest").alias("most"))
    if not same.filter("least <> most").isEmpty():
        raise ValueError("a span differs from the words at its source")
    left = cut.filter("kept is not null").select("n", "n_removed", "kept").distinct().join(numbered, "n")
    left = left.select(F.col("doc_id").alias("_id"), F.col("xt").alias("_xt"), "n_removed", "kept")
    out = rows.join(left, rows["doc_id"].eqNullSafe(left["_id"]) & (rows["xt"] == left["_xt"]) & rows["is_first"], "left")
    copy = ~F.col("is_first") & (F.col("n_words") >= window)
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept", "digest")).alias("kept_digest"))
