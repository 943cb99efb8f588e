"""Packing of tokenised documents into sequences of bounded length, by patterns.

Documents longer than the limit are cut into pieces; all that packing needs to know of the pieces is the histogram of
their lengths, which has as many bars as the limit has tokens. On it the driver plans: patterns of up to three lengths
that fill a sequence exactly are enumerated, repeat counts are fitted to the histogram by non-negative least squares
and rounded down, and what is left is packed best fit first, longest lengths first, whole bars at a time. The plan
gives ranks of each length to ranges of sequences, so that every piece finds its place from its length and its rank
among the pieces of that length. Ranks come from counts per partition; no length's pieces ever meet in one task.
"""

from __future__ import annotations

import re
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailloom.llm.common import stored, text_of

LIMIT = 2048
END = 0
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words kept in the cache of a worker, twice at most: when it is full, it becomes the old one that a new one draws on.
CACHE = 500_000
#: Pieces per pattern that the enumeration aims at: fewer pieces take a coarser grid of patterns.
PER_PATTERN = 8
ROUNDS = 150
#: Letters whose lower case and composition don't depend on their neighbours, and marks that no contraction starts with.
LATIN = re.compile("[a-zà-öø-ÿ]+")
MARKS = "".join(sorted(set(string.punctuation) - {"'"}))
#: The tokenizer's characters for bytes: printable ones stand for themselves, the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class Encoder:
    """Token ids of texts as little-endian bytes. Words are encoded once: the tokenizer never merges across ASCII
    white space, and reads A-Z as a-z. Texts with markers of special tokens, which white space and case may be part of,
    are encoded as they are."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cache, self.old = self.tokenizer.model, {}, {}
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pretoken(self, token: str) -> bytes:
        """Ids of lower-case letters, or of marks, which the tokenizer reads as the characters of their bytes."""
        if not token.isascii():
            token = token.encode().decode("latin-1").translate(BYTES)
        return np.array([t.id for t in self.model.tokenize(token)], "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        """Ids of a word: at once if it is Latin letters and perhaps marks behind them, else by the whole tokenizer."""
        text = word.decode()
        stem = text.rstrip(MARKS)
        low = stem.lower()
        if not LATIN.fullmatch(low):
            return self.plain(text)
        found = self.pretoken(low)
        return found + self.pretoken(text[len(stem):]) if len(stem) < len(text) else found

    def ids(self, text: bytes) -> bytes:
        if any(mark in text for mark in self.marks):
            return self.plain(text.decode())
        words, known = text.lower().split(), self.cache
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > CACHE:
                self.old, self.cache = known, {}
                known = self.cache
            for w in words:
                if w not in known:
                    known[w] = self.old.get(w) or self.word(w)
            return b"".join([known[w] for w in words])


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process, so that its cache serves all tasks that the worker runs."""
    return Encoder(path)


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, limit: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, slot, local (rank of the piece in its slot among those of its length)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(path), np.zeros(limit + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "slot", "local"]
        for batch in batches:
            row, piece, start, length, crc, local = [], [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                ids = encoder.ids(text) + np.array([END], "<u4").tobytes()
                for number, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at: at + 4 * limit]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    local.append(seen[n])
                    seen[n] += 1
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(row), pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)), batch["slot"].take(row),
                pa.array(local, pa.int64())], names)

    slim = docs.select(docs[id_col].alias("doc_id"), text_of(docs[text_col]).cast("binary").alias("text"),
                       F.spark_partition_id().alias("slot"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, slot int, local long")


class Segment(NamedTuple):
    """The pieces of one length with ranks from `rank` go, `each` to a sequence, to sequences from `sequence`, from
    `offset` on."""

    length: int
    rank: int
    sequence: int
    each: int
    offset: int


def patterns(counts: np.ndarray, limit: int) -> np.ndarray:
    """Up to three lengths (0: none) that fill a sequence exactly, descending, as rows of an n x 3 array.

    Pairs are all there. Triples lie on a grid that is as fine as the number of pieces warrants, and exact from some
    millions of pieces on.
    """
    pairs = np.arange((limit + 1) // 2, limit)
    pairs = np.stack([pairs, limit - pairs, np.zeros_like(pairs)], 1)
    wanted = max(1.0, counts[1:limit].sum() / PER_PATTERN)
    step = max(1, int(np.ceil(np.sqrt(limit * limit / 12 / wanted))))
    a, b = np.meshgrid(np.arange(1, limit, step), np.arange(1, limit, step), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = limit - a - b
    fits = (a >= b) & (b >= c) & (c > 0)
    triples = np.stack([a, b, c], 1)[fits]
    every = np.concatenate([pairs, triples])
    return every[((counts[every] > 0) | (every == 0)).all(1)]


def fit(counts: np.ndarray, rows: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: x >= 0 of least |A x - counts|, A[l, p] the times that pattern p has length l.

    Multiplicative updates x <- x * (A'b) / (A'A x), which keep x non-negative and never raise the error. Each
    product is a sum over the patterns' lengths.
    """
    weight = (rows > 0).astype(float)

    def back(y: np.ndarray) -> np.ndarray:
        return (y[rows] * weight).sum(1)

    def forth(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (weight * x[:, None]).ravel(), len(counts))

    goal = back(counts.astype(float))
    x = np.full(len(rows), counts[1:].sum() / max(1, 3 * len(rows)))
    for _ in range(rounds):
        x *= goal / np.maximum(back(forth(x)), 1e-12)
    return x


def plan(counts: np.ndarray, limit: int = LIMIT) -> tuple[list[Segment], int]:
    """Histogram of lengths (index 0 unused) -> segments that place every piece, and the number of sequences."""
    left, rank = counts.astype(np.int64).copy(), np.zeros(limit + 1, np.int64)
    segments: list[Segment] = []
    sequences = 0

    def give(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        segments.append(Segment(length, int(rank[length]), sequence, each, offset))
        rank[length] += n
        left[length] -= n

    if left[limit]:
        n = int(left[limit])
        give(limit, n, 0, 1, 0)
        sequences = n
    rows = patterns(left, limit)
    repeats = np.floor(fit(left, rows)).astype(np.int64) if len(rows) else np.array([], np.int64)
    for p in np.argsort(-repeats, kind="stable"):
        lengths = [int(x) for x in rows[p] if x]
        n = min(int(repeats[p]), *(int(left[x]) // lengths.count(x) for x in lengths))
        if n > 0:
            offset = 0
            for x in lengths:
                give(x, n, sequences, 1, offset)
                offset += x
            sequences += n
    # Best fit of what is left: open sequences are ranges under the room that they have.
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, start: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((start, n))

    for length in range(limit - 1, 0, -1):
        while left[length]:
            n = int(left[length])
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = limit // length
                full, rest = divmod(n, each)
                if full:
                    give(length, full * each, sequences, each, 0)
                    put(limit - each * length, sequences, full)
                    sequences += full
                if rest:
                    give(length, rest, sequences, rest, 0)
                    put(limit - rest * length, sequences, 1)
                    sequences += 1
                continue
            room = rooms[at]
            start, many = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = min(room // length, n)
            used = min(many, n // each)
            give(length, used * each, start, each, limit - room)
            put(room - each * length, start, used)
            put(room, start + used, many - used)
    return segments, sequences


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
         limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text, without special tokens, and the end id; null counts as empty, so it is the
    end id alone. Only documents of over limit ids are cut, the last piece may be shorter. Sequences are gapless from
    offset 0, hold whole pieces, and are numbered from 0. Repeated rows are packed each. An empty table gives no rows.
    Other columns aren't looked at.
    """
    cut = stored(pieces(docs, id_col, text_col, tokenizer, limit), "pieces")
    sums = stored(cut.groupBy("slot", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(limit + 1, np.int64)
    for row in sums.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most limit rows
        counts[row["length"]] = row["n"]
    segments, _ = plan(counts, limit)
    segments.sort()
    table = np.array(segments, np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            found = table[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            nth = rank - found[:, 1]
            sequence, offset = found[:, 2] + nth // found[:, 3], found[:, 4] + nth % found[:, 3] * length
            kept = [batch[name] for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], out)

    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("slot", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["slot", "length"]).withColumn("rank", F.col("base") + F.col("local")).drop("base", "local")
    kind = dict(cut.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
