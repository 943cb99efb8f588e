"""Language-model scores by a probabilistic suffix tree over words.

A context is the last one to `depth` words. Those that occur often enough in the training texts are candidates; one becomes
a state of the tree if its next words diverge from those of its longest suffix in the tree: each occurrence is taken out
of the context's counts in turn and predicted by the rest (so chance pairs don't count), and the log-likelihood that this
gains over the suffix, over all its occurrences, must exceed a threshold. A state's distribution is its counts smoothed by
its suffix's distribution; the root's is that of single words. A word is scored in the longest suffix of its text that is
a state, the text's end counting as a word.

Contexts and next words are the arcs of a counted automaton (`arcs`): shards sum them, ranges unite them, decide about the
contexts that they hold and answer. Contexts with a thousandth of all words or more (so at most a thousand) are dealt
out word by word; what each range finds about them is added up, and the driver decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm import arcs
from mailloom.llm.arcs import BREAK, Level, Rule, Union
from mailloom.llm.common import stored, text_of

DEPTH = 2
#: Occurrences of a context that may become a state.
LEAST = 16
#: How many occurrences the suffix's distribution counts for.
PRIOR = 12.0
#: Gain in natural logarithms that a state must bring.
DIVERGENCE = 6.0
HOT_SHARE, HOT_LEAST = 1000, 1 << 16


class Tree(NamedTuple):
    """What scoring needs beside the answers. n, v: training tokens, and different ones. hot: states among hot contexts, by
    level."""

    n: int
    v: int
    hot: dict[int, np.ndarray]
    prior: float

    def probabilities(self, levels: list[Level]) -> np.ndarray:
        """Of each token, in the longest state that the answered levels know."""
        found = (levels[0].totals + 1) / (self.n + self.v + 1)
        for level in levels[1:]:
            if level.totals is not None:
                state = (level.context >= 0) & ((level.kept > 0) | np.isin(level.context, self.hot[level.number]))
                found = np.where(state, (level.totals + self.prior * found) / (level.weight + self.prior), found)
        return found


def cut(text: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case, and BREAK as its end."""
    return text.lower().split() + [BREAK]


def gains(union: Union, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, which one each arc has, their totals, log-likelihood of their next words over the suffix's), up to the
    total's own part. Each occurrence is predicted without itself."""
    contexts, which = np.unique(union.keys >> np.uint64(32), return_inverse=True)
    seen = union.totals > 0
    p, n = union.priors[seen], union.totals[seen]
    gain = np.bincount(which[seen], n * (np.log(n - 1 + prior * p) - np.log(p)), len(contexts))
    return contexts, which, np.bincount(which, union.totals, len(contexts)).astype(np.int64), gain


def diverges(gain: np.ndarray, total: np.ndarray, prior: float, divergence: float) -> np.ndarray:
    return gain - total * np.log(np.maximum(total - 1 + prior, 1e-300)) > divergence


class Parameters(NamedTuple):
    depth: int = DEPTH
    least: int = LEAST
    prior: float = PRIOR
    divergence: float = DIVERGENCE
    hot_share: int = HOT_SHARE
    hot_least: int = HOT_LEAST


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          parameters: Parameters = Parameters()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known (tokens that training texts have), train_tokens (all of
    theirs), base_score and score: log10 of the text's probability by single words and by the tree.

    Only texts that aren't held out (null counts as not) are learnt from. A null text is an empty one, and consists of its
    end. Repeated rows count each time. Without training texts every score is 0, and an empty table gives no rows; other
    columns aren't looked at. Words are told apart by 64 bits of hash.
    """
    depth, least, prior, divergence, hot_share, hot_least = parameters
    if depth < 1 or least < 1 or prior <= 0:
        raise ValueError("depth and least are 1 or more, prior is above 0")
    rows = docs.select(docs[id_col].alias("who"), (~F.coalesce(held_out, F.lit(False))).alias("train"),
                       text_of(docs[text_col]).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["who"]
    shards = stored(arcs.shards(rows, cut).drop("names", "owners", "words"), "shards")
    ranges = arcs.ranges_of(docs)
    rule = Rule(ranges, 1, least)
    firsts: dict[int, np.ndarray] = {}
    tree = Tree(0, 0, {}, prior)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                level = next(arcs.walk(shard, [], {}, rule))
                counts = arcs.numbers(shard["counts"], np.int32)
                yield from arcs.ask(shard["shard"], level, counts[level.first]).to_batches()

    def united_words(rows: pa.Table) -> pa.Table:
        union = arcs.unite(rows)
        return arcs.answer(0, union, 1, np.zeros(len(union.which), np.int8))

    def nexts(shard: dict, answers: list[dict]) -> pa.Table:
        levels = list(arcs.walk(shard, answers, firsts, rule))
        last, train = levels[-1], np.repeat(np.array(shard["train"], bool), shard["sizes"])
        counts = np.bincount(last.which, train[last.at], len(last.keys))
        return arcs.ask(shard["shard"], last, counts, tree.probabilities(levels)[last.first])

    def united(number: int):
        reply_ranks = least if number < depth else 1 << 62  # the last level's arcs lead to no context

        def of(rows: pa.Table) -> pa.Table:
            union = arcs.unite(rows)
            contexts, which, total, gain = gains(union, prior)
            kept, extra = np.zeros(len(contexts), bool), []
            if union.p < ranges:
                kept = diverges(gain, total, prior, divergence)
            else:
                extra = [{"keys": arcs.steps(contexts), "totals": arcs.planes(total), "kept": arcs.planes(gain)}]
            return arcs.answer(number, union, reply_ranks, kept[which][union.which], extra)
        return of

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(arcs.from_steps(row["keys"]).astype(np.int64)), pa.array(arcs.numbers(row["totals"], np.int64)),
                     pa.array(arcs.numbers(row["kept"], np.float64))], ["context", "total", "gain"])

    def scored(shard: dict, answers: list[dict]) -> pa.Table:
        levels = list(arcs.walk(shard, answers, firsts, rule))
        starts = np.cumsum([0, *shard["sizes"][:-1]])
        known = levels[0].totals > 0
        base = np.log10((levels[0].totals + 1) / (tree.n + tree.v + 1))
        return pa.table({
            "doc_id": shard["_who"], "held_out": pa.array([not x for x in shard["train"]], pa.bool_()),
            "n_tokens": pa.array(shard["sizes"], pa.int64()), "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts)),
            "train_tokens": pa.array([tree.n] * len(starts), pa.int64()), "base_score": pa.array(np.add.reduceat(base, starts)),
            "score": pa.array(np.add.reduceat(np.log10(tree.probabilities(levels)), starts))})

    asked = shards.select("shard", "ids", "keys", "counts").mapInArrow(words, arcs.ASKS)
    levels = [stored(asked.groupBy("p").applyInArrow(united_words, arcs.ANSWERS), "words")]
    firsts[0], n, v = arcs.offsets(levels[0], 2 * ranges)
    tree = tree._replace(n=n, v=v)
    rule = rule._replace(hot=max(hot_least, n // hot_share))
    for number in range(1, depth + 1):
        asked = arcs.meet(shards.select("shard", "ids", "keys", "train", "sizes"), levels, nexts, arcs.ASKS)
        levels.append(stored(asked.groupBy("p").applyInArrow(united(number), arcs.ANSWERS), f"contexts{number}"))
        firsts[number] = arcs.offsets(levels[-1], 2 * ranges)[0]
        parts = levels[-1].filter("shard is null and ranked is null").select("keys", "totals", "kept")
        found = parts.mapInArrow(hot, "context long, total long, gain double").groupBy("context").agg(
            F.sum("total").alias("total"), F.sum("gain").alias("gain")).collect()  # hot ones only: hot_share at most
        total, gain = np.array([r["total"] for r in found], np.int64), np.array([r["gain"] for r in found], np.float64)
        states = np.array([r["context"] for r in found], np.int64)[diverges(gain, total, prior, divergence)]
        tree = tree._replace(hot=tree.hot | {number: states})
    return arcs.meet(shards.select("shard", "ids", "keys", "train", "sizes", "who"), levels, scored,
                     f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
