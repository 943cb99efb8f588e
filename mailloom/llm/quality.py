"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document is a bag of terms: triples of character classes (letters, digits, white space, marks, each common symbol on
its own), and structure terms that count how much of the text repeats earlier windows of words or earlier lines, how
long words and lines are, and the like. Term weights are damped, scaled by inverse document frequency, and projected to
the leading singular vectors of the labelled sample. Every document is compared with every labelled vector, exactly,
in blocks; the nearest ones vote with their label, weighted by similarity.

The labelled sample is bounded (`sample`), so its vectors can be broadcast: by default at most 4,096 x 48 doubles,
under 2 MB. Everything else looks at all documents and at whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.llm.common import fresh, text_of

SAMPLE = 4096
DIMENSIONS = 48
NEIGHBOURS = 25
#: A similarity counts to this power, so that near neighbours outvote far ones.
POWER = 8
BLOCK = 512
SYMBOLS = "#*$%&|<>!?.,"
CLASSES = 16
TRIPLES = CLASSES ** 3
#: Levels of each structure term, and how heavily one weighs against the triples.
LEVELS = 12
STRUCTURE = ("repeated words", "repeated lines", "distinct words", "word length", "line length", "words")
TERMS = TRIPLES + LEVELS * len(STRUCTURE)
STRUCTURE_WEIGHT = 0.35


def classes() -> np.ndarray:
    """Class of each byte: 0 white space, 1 lower case, 2 upper case or digit, 3 part of a non-ASCII character, then
    the symbols; 2 also stands for what is left."""
    found = np.full(256, 2, np.int64)
    found[[9, 10, 11, 12, 13, 32]] = 0
    found[ord("a"): ord("z") + 1] = 1
    found[128:] = 3
    for i, symbol in enumerate(SYMBOLS):
        found[ord(symbol)] = 4 + i
    return found


def soft_level(value: float, row: np.ndarray) -> None:
    """A value in [0, 1] spread over its two nearest levels."""
    at = min(max(value, 0.0), 1.0) * (LEVELS - 1)
    low = int(at)
    row[low] += low + 1 - at
    if at > low:
        row[low + 1] += at - low


def repeats(words: list[bytes]) -> float:
    """The share of 3-word windows that occur again in the text."""
    if len(words) < 3:
        return 0.0
    h = np.fromiter(map(hash, words), np.int64, len(words))
    with np.errstate(over="ignore"):
        windows = (h[:-2] * 1000003 ^ h[1:-1]) * 1000003 ^ h[2:]
    counts = np.unique(windows, return_counts=True)[1]
    return float(counts[counts > 1].sum() / len(windows))


def terms(texts: list[bytes]) -> np.ndarray:
    """Texts -> one row of damped term weights each; triples and structure terms have fixed shares of its length."""
    of, out = classes(), np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        code = of[np.frombuffer(text, np.uint8)]
        if len(code) > 2:
            counts = np.bincount((code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:], minlength=TRIPLES)
            row[:TRIPLES] = np.sqrt(counts / counts.sum())
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        n = max(1, len(words))
        values = (
            repeats(words), 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / n,
            sum(map(len, words)) / n / 20, np.log1p(len(words) / max(1, len(lines))) / 8, np.log1p(len(words)) / 12)
        for i, value in enumerate(values):
            soft_level(float(value), row[TRIPLES + i * LEVELS:][:LEVELS])
        row[TRIPLES:] *= STRUCTURE_WEIGHT
    return out


def whole(x: np.ndarray, bits: int) -> np.ndarray:
    """x in steps of 2 ** -bits, as integral doubles."""
    return np.rint(np.asarray(x, np.float64) * (1 << bits))


class Model(NamedTuple):
    """Sums over terms and axes are of integers below 2 ** 53, so they are exact in doubles, and no score depends on
    how many rows are multiplied at a time or in which order a matrix product adds."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of term weights, as integral doubles in steps of 2 ** -20."""
        found = whole(rows, 20) @ whole(self.idf[:, None] * self.axes, 20)
        found = np.rint(found / (1 << 22))  # steps of 2 ** -18, whose squares still add up exactly
        return whole(found / np.maximum(np.sqrt((found * found).sum(1, keepdims=True)), 1e-9), 20)

    def scores(self, texts: list[bytes], neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = []
        for at in range(0, len(texts), BLOCK):
            alike = (self.project(terms(texts[at: at + BLOCK])) @ self.vectors.T) / (1 << 40)
            k = min(neighbours, alike.shape[1])
            near = np.argpartition(-alike, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(alike, near, 1), 1e-6) ** POWER
            out.append((weight * self.labels[near]).sum(1) / weight.sum(1))
        return np.concatenate(out) if out else np.zeros(0)


def leading_axes(rows: np.ndarray, dimensions: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors, as columns, by subspace iteration from a fixed start."""
    axes = np.random.default_rng(0).standard_normal((rows.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(rounds):
        axes = np.linalg.qr(rows.T @ (rows @ axes))[0]
    turn = np.linalg.svd(rows @ axes, full_matrices=False)[2]
    return (axes @ turn.T)[:, :dimensions]


def train(rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model | None:
    """A model of the term weights of labelled texts (changed in place); None if there are none."""
    if not len(rows):
        return None
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))).astype(np.float32) + 1
    rows *= idf  # in place: the rows of the sample are the largest thing on the driver
    axes = leading_axes(rows, dimensions).astype(np.float32)
    model = Model(np.ones_like(idf), axes, np.zeros((0, 0), np.float32), labels.astype(np.float32))
    vectors = np.concatenate([model.project(rows[at: at + BLOCK]) for at in range(0, len(rows), BLOCK)])
    return model._replace(vectors=vectors, idf=idf)


def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> their terms, as places and weights of those that aren't zero."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            rows = terms(part["text"].to_pylist())
            places = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [part["_id"], part["_label"], pa.array([p.astype(np.int16).tobytes() for p in places], pa.binary()),
                 pa.array([r[p].tobytes() for r, p in zip(rows, places, strict=True)], pa.binary())],
                ["_id", "_label", "places", "values"])


def labelled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Term weights and labels of at most `sample` labelled training texts that docs holds, those of smallest hash.
    Their terms are worked out where the texts are, so no text of any length reaches the driver.

    Training rows are those whose crc32 of the identifier, as text, isn't 1 modulo 3, with quality 0 or 1. Several
    labels of one identifier vote, a tie counts as 1.
    """
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    rows = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
    rows = rows.join(docs.select(docs[id_col].alias("doc_id")), "doc_id", "left_semi")
    order = F.xxhash64(F.lit("sample"), "doc_id")
    rows = rows.orderBy(order, "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    found = docs.select(docs[id_col].alias("_id"), text_of(docs[text_col]).cast("binary").alias("text"))
    found = found.join(F.broadcast(rows), "_id").groupBy("_id", "_label").agg(F.min("text").alias("text"))
    kind = dict(found.dtypes)["_id"]
    found = found.mapInArrow(weights, f"_id {kind}, _label int, places binary, values binary").collect()
    found.sort(key=lambda r: r["_id"])
    out = np.zeros((len(found), TERMS), np.float32)
    for row, r in zip(out, found, strict=True):
        row[np.frombuffer(r["places"], np.int16)] = np.frombuffer(r["values"], np.float32)
    return out, np.array([r["_label"] for r in found], np.float32)


def string_fields(docs: DataFrame, names: list[str]) -> list[tuple[list[str], list[str]]]:
    """The string columns among names, and those in each of their structs: (path of the struct, fields)."""
    kept = [f for f in docs.schema if f.name in names]
    strings = lambda fields: [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return [([], strings(kept)), *(([f.name], strings(f.dataType)) for f in kept if isinstance(f.dataType, T.StructType))]


def texts_at(batch: pa.RecordBatch, place: list[str]) -> list[bytes]:
    """The texts of a string column, or of a field of a struct; null is empty."""
    column = batch[place[0]]
    for name in place[1:]:
        column = pc.struct_field(column, name)
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, likelihood of label 1) and predicted (1 from 0.5 on), whatever other columns there are.

    A null text is an empty one, and gets a score too, as do texts in any language and of any length. Labels are
    learnt from training rows only (see `labelled`); without any, every score is 0.5. Scores depend on texts alone, so
    equal texts have equal scores. An empty table gives no rows. docs' own columns score and predicted are replaced.
    """
    model = train(*labelled(docs, labels, sample, id_col, text_col))
    names, bytes_ = [c for c in docs.columns if c.lower() not in ("score", "predicted")], fresh(docs, "bytes")
    share = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    place = next(([*box, i] for box, fields in string_fields(docs, names) for i in fields if ".".join([*box, i]) == text_col), None)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
            texts = batch[bytes_].to_pylist() if place is None else texts_at(batch, place)
            found = share.value.scores(texts) if share.value else np.full(len(texts), 0.5)
            found = np.clip(np.asarray(found, np.float64), 0, 1)
            predicted = pa.array((found >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(found), predicted], [*names, "score", "predicted"])

    # A text that is among the columns, or in a struct of them, travels once, as it is there.
    rows = docs.select(*names, *([] if place else [text_of(docs[text_col]).cast("binary").alias(bytes_)]))
    schema = docs.select(*names).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    for field in schema:
        field.nullable = True
    return rows.mapInArrow(of, schema)


def survivors(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    boxed = docs.select(F.struct("*").alias("row"))
    return score(boxed, labels, sample, f"row.{id_col}", f"row.{text_col}").filter("predicted = 1").select("row.*")
