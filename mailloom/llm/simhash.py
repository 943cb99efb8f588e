"""SimHash near-duplicates: fingerprints at most 3 bits apart are linked; links make components.

Candidates come from fuzzy keys. A fingerprint is cut into segments of 23, 23 and 18 bits, and each segment is decoded
to the codewords near it (golay.decode: one, or six). Three errors leave two cases:

* some segment has none. It then goes into the key as it is, together with a codeword of a second segment that has two
  at most; the third is free. Three such tables are enough: A exact with C, B with A, C with B.
* each segment has one. Then each word's own codeword is among those of the other. One side spreads over the codewords
  of A and keeps its own of B and C, the other side the reverse.

So a fingerprint has about 50 keys of 30 to 36 bits, and those of different fingerprints hardly meet by chance. Every
pair that meets is verified. A large bucket of many near copies gives a spanning forest of verified links, not all
pairs, and a bucket beyond CHUNK fingerprints is split into pairs of chunks, each a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm import golay
from mailloom.llm.common import look_up, rows_named, shuffle_partitions, stored, text_of
from mailloom.llm.components import components, dealt

WORDS = 3
SEED = 42
DISTANCE = 3
#: (shift, bits) of the segments A, B and C.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Exact segment, fuzzy segment.
ONE_EXACT = ((0, 2), (1, 0), (2, 1))
#: Up to this many fingerprints of a bucket, all verified pairs are returned.
FEW = 8
CHUNK = 8192
BLOCK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text: a bit is 1 if it is in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(whole, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: 1 - WORDS].tolist(), ends[WORDS - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        hashes = [xxhash.xxh64_intdigest(whole[a:b], SEED)
                  for a, b in zip(first[at: at + BLOCK], last[at: at + BLOCK], strict=True)]
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the text), fp (the fingerprint as a signed long), slot."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            rows = [batch["doc_id"], batch["digest"], pa.array(found), batch["slot"]]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "digest", "fp", "slot"])

    text = text_of(docs[text_col])
    slim = docs.select(docs[id_col].alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"),
                       text.cast("binary").alias("text"), F.spark_partition_id().alias("slot"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(of, f"doc_id {kind}, digest binary, fp long, slot int")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (signed) -> (key, fingerprint), one row per key."""
    unsigned = fps.view(np.uint64)
    parts = [(unsigned >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    near = [golay.decode(part) for part in parts]
    some = [np.arange(golay.WAYS) < ways[:, None] for _, ways in near]
    own = [codes[:, 0] for codes, _ in near]
    keys, rows = [], []
    every = np.arange(len(fps))
    for number, (exact, fuzzy) in enumerate(ONE_EXACT):
        key = (number << 48) | (parts[exact][:, None] << 12) | near[fuzzy][0]
        keys.append(key[some[fuzzy]])
        rows.append(np.broadcast_to(every[:, None], key.shape)[some[fuzzy]])
    a, b, c = (codes for codes, _ in near)
    key = (3 << 48) | (a << 24) | (own[1] << 12)[:, None] | own[2][:, None]
    keys.append(key[some[0]])
    rows.append(np.broadcast_to(every[:, None], key.shape)[some[0]])
    key = (3 << 48) | (own[0] << 24)[:, None, None] | (b << 12)[:, :, None] | c[:, None, :]
    both = some[1][:, :, None] & some[2][:, None, :]
    keys.append(key[both])
    rows.append(np.broadcast_to(every[:, None, None], key.shape)[both])
    return np.concatenate(keys), fps[np.concatenate(rows)]


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one bucket."""
    label, links = np.arange(len(fps)), ([], [])
    for i in range(len(fps) - 1):
        other = np.flatnonzero(near(fps[i + 1:], fps[i])) + i + 1
        other = other[label[other] != label[i]]
        if len(other):
            labels, first = np.unique(label[other], return_index=True)
            links[0].append(np.full(len(first), fps[i]))
            links[1].append(fps[other[first]])
            label[np.isin(label, labels)] = label[i]
    return tuple(np.concatenate(x) if x else np.array([], np.uint64) for x in links)


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within whole buckets, rows sorted by key."""
    found = ([], [])

    def add(a: np.ndarray, b: np.ndarray) -> None:
        found[0].append(a)
        found[1].append(b)

    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    few = (sizes > 1) & (sizes <= FEW)
    size = np.repeat(np.where(few, sizes, 0), sizes)
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    for step in range(1, FEW):
        a = np.flatnonzero(place + step < size)
        linked = a[near(fps[a], fps[a + step])]
        add(fps[linked], fps[linked + step])
    for start, n in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        add(*forest(fps[start: start + n]))
    return np.concatenate(found[0]), np.concatenate(found[1])


def linker(chunk: int | None):
    """A function over batches of (key, fp), sorted, to links (a, b) and to rows of buckets beyond chunk."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, key=None, number=None) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([
                pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)),
                none if key is None else pa.array(np.full(len(a), key, np.int64)),
                none if number is None else pa.array(np.full(len(a), number, np.int64)),
            ], ["a", "b", "key", "chunk"])

        keys, fps, number = np.array([], np.int64), np.array([], np.uint64), 0
        for batch in batches:
            keys = np.r_[keys, batch["key"].to_numpy()]
            fps = np.r_[fps, batch["fp"].to_numpy().view(np.uint64)]
            if not len(keys):
                continue
            if number and keys[0] != keys[-1]:  # the rest of a bucket that is given out in chunks
                end = int(np.searchsorted(keys, keys[0], "right"))
                yield out(fps[:end], None, keys[0], number)
                keys, fps, number = keys[end:], fps[end:], 0
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield out(*bucket_links(keys[:end], fps[:end]))
                keys, fps = keys[end:], fps[end:]
            while chunk and len(keys) > chunk:
                yield out(fps[:chunk], None, keys[0], number)
                keys, fps, number = keys[chunk:], fps[chunk:], number + 1
        if number:
            yield out(fps, None, keys[0], number)
        elif len(keys):
            yield out(*bucket_links(keys, fps))

    return links


LINKS = "a long, b long, key long, chunk long"


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) with the same components as all pairs at most DISTANCE bits apart."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = keys_of(batch["fp"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])

    n = shuffle_partitions(distinct.sparkSession)
    keyed = distinct.mapInArrow(keys, "key long, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")
    found = stored(keyed.mapInArrow(linker(chunk), LINKS), "links")
    rest = found.filter("chunk is not null").select("key", F.col("a").alias("fp"), "chunk")
    direct = found.filter("chunk is null").select("a", "b")
    if rest.isEmpty():
        return direct
    last = rest.groupBy("key").agg(F.max("chunk").alias("last"))
    pairs = look_up(dealt(rest, "fp"), last, ["key"]).withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    pairs = pairs.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "fp")
    pairs = pairs.repartition(n, "key").sortWithinPartitions("key", "fp")
    return direct.unionByName(pairs.mapInArrow(linker(None), LINKS).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, digest, fp (signed long), component_id (its smallest doc_id), named.

    Texts are read whole, in UTF-8 with A-Z in lower case; null counts as empty. A text without words has fingerprint
    zero and is linked like any other; one of one or two words is a single shingle. Equal fingerprints are linked, so
    copies and repeated rows share a component. A null identifier never names a component unless all of it are null.
    named is true for the rows with the component's name and, if several texts bear it, with the smallest digest.
    An empty table gives no rows; other columns aren't looked at.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    groups = stored(prints.groupBy("fp").agg(first), "groups")
    roots = components(links(groups.select("fp"), chunk)).withColumnRenamed("node", "fp")
    groups = groups.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    groups = stored(groups, "rooted")
    names = groups.groupBy("root").agg(F.min("first").alias("name"))
    named = look_up(dealt(groups, "fp"), names, ["root"]).select("fp", "name")
    is_name = F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("digest") == F.col("name.digest"))
    return look_up(prints, named, ["fp"]).select(
        "doc_id", "digest", "fp", F.col("name.doc_id").alias("component_id"), is_name.alias("named"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs per component, the named one, with all its columns."""
    return rows_named(docs, near_duplicates(docs, id_col, text_col).filter("named"), id_col, text_col)
