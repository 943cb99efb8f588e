"""Counted automata of word sequences, built level by level from shards of a corpus.

A state is a sequence of words that occurs often enough; an arc leads from a state over one more word and has the
number of its occurrences as weight. Level 0 has one arc per word, from the empty sequence. Level d is built from level
d - 1: at every place of the text the state of the d words before it is known, so state and word make an arc.

* A shard is about a million words of consecutive documents: one row with the words as numbers of its own dictionary.
* Each shard sorts its arcs, adds up equal ones, and deals them out by ranges of a mixed key: one row per shard and
  range, sorted keys and weights packed into a binary column. So arcs are summed before they shuffle, and one of any
  frequency comes once per shard.
* A range's task unites the sorted arcs of all shards, adds up their weights, numbers the arcs heavy enough to be states
  of the next level, and answers each shard in the order in which it asked.
* A shard and its answers then meet by the shard's number, and its next level can be asked.

What one task holds is a shard, or a range of arcs; there are as many of both as the corpus asks for. The driver gets one
row of figures per range.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import shuffle_partitions

SHARD = 1 << 20
#: Ends a sequence; no byte of UTF-8.
BREAK = b"\xff"
UNKNOWN = (1 << 32) - 1
ASKS = "p int, shard long, keys binary, counts binary, priors binary"
ANSWERS = ("level int, shard long, p int, totals binary, ranks binary, kept binary, keys binary, "
           "n long, v long, ranked long")


def planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second bytes, and so on, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def numbers(packed: bytes, kind: type) -> np.ndarray:
    raw, size = zstandard.ZstdDecompressor().decompress(packed), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def steps(x: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(numbers(raw, np.uint64), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dealt(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key, rising with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def shards(rows: DataFrame, cut: Callable[[bytes], list[bytes]], per_who: bool = False, size: int = SHARD) -> DataFrame:
    """rows (who, train, text as binary) -> shards of whole texts.

    cut gives the words of a text with BREAK after each sequence, at least one. who, train, sizes, words: per text,
    whose it is, whether it is counted, its words with breaks and without. ids: numbers of the shard's dictionary, 0 for
    BREAK; keys: the hash of each word of the dictionary, told apart by `who` if per_who; names: the words themselves,
    and owners: the first text that has them. A word counts as its 64-bit hash from here on.
    """
    kind = dict(rows.dtypes)["who"]
    schema = pa.schema([
        ("shard", pa.int64()), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
        ("words", pa.list_(pa.int32())), ("ids", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()),
        ("owners", pa.binary()), ("names", pa.list_(pa.binary()))])

    def whole(shard: int, who: list, train: list, sizes: list, words: list, ids: array, tables: dict) -> list[pa.Array]:
        names = [BREAK] * (1 + sum(len(t) - 1 for _, t in tables.values()))
        owners = [0] * len(names)
        for first, known in tables.values():
            for word, i in known.items():
                names[i], owners[i] = word, first
        seeds = [str(x).encode() + BREAK for x in who] if per_who else [b""] * len(who)
        keys = [xxhash.xxh3_64_intdigest(seeds[o] + w) for w, o in zip(names, owners, strict=True)]
        number = np.frombuffer(ids, np.int32)
        counted = np.bincount(number[np.repeat(np.array(train, bool), sizes)], minlength=len(names))
        row = [shard, train, sizes, words, planes(number), planes(np.array(keys, np.uint64)),
               planes(counted.astype(np.int32)), planes(np.array(owners, np.int32)), names]
        return [pa.array([x], f.type) for x, f in zip(row, schema, strict=True)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, count()
        who_type = None

        def fresh():
            numbers_, tables = count(1), {}
            return [], [], [], [], array("i"), tables, numbers_

        who, train, sizes, words, ids, tables, following = fresh()

        def done() -> pa.RecordBatch:
            arrays = whole(base + next(made), who, train, sizes, words, ids, tables)
            return pa.RecordBatch.from_arrays([*arrays, pa.array([who], pa.list_(who_type))], [*schema.names, "who"])

        for batch in batches:
            who_type = batch["who"].type
            for i in range(batch.num_rows):
                owner, text = batch["who"][i].as_py(), batch["text"][i].as_py()
                at = owner if per_who else None
                if at not in tables:
                    tables[at] = (len(who), defaultdict(following.__next__, {BREAK: 0}))
                found, before = cut(text), len(ids)
                ids.extend(map(tables[at][1].__getitem__, found))
                who.append(owner)
                train.append(batch["train"][i].as_py())
                sizes.append(len(ids) - before)
                words.append(len(found) - found.count(BREAK))
                if len(ids) >= size:
                    yield done()
                    who, train, sizes, words, ids, tables, following = fresh()
        if who:
            yield done()

    return rows.mapInArrow(of, "shard long, train array<boolean>, sizes array<int>, words array<int>, ids binary, keys binary, "
                               f"counts binary, owners binary, names array<binary>, who array<{kind}>")


class Rule(NamedTuple):
    """What makes a state: `words` occurrences of a word, `least` of longer sequences; with `suffix`, the sequence without
    its first word must be a state as well. Arcs from states of over `hot` occurrences are dealt out arc by arc into
    `ranges` of their own, others state by state; with `hot` 0 all of them arc by arc."""

    ranges: int
    words: int
    least: int
    suffix: bool = False
    hot: int = 0


class Level(NamedTuple):
    """One level of a shard. keys: its distinct arcs, sorted; first: a place of each; at, which: places that have an arc,
    and which one; ranges, order: the arcs' ranges, and the order in which they are asked. context, weight: at each place,
    the state of the words before it (or -1) and its total. totals, states, kept: the answers at each place, if any."""

    number: int
    keys: np.ndarray
    first: np.ndarray
    at: np.ndarray
    which: np.ndarray
    ranges: np.ndarray
    order: np.ndarray
    context: np.ndarray
    weight: np.ndarray
    totals: np.ndarray | None = None
    states: np.ndarray | None = None
    kept: np.ndarray | None = None


def answered(level: Level, rows: list[dict], offsets: np.ndarray) -> Level:
    rows = sorted(rows, key=lambda r: r["p"])
    n = len(level.context)

    def spread(column: str, kind: type, empty: int) -> np.ndarray:
        values = np.empty(len(level.keys), kind)
        values[level.order] = np.concatenate([numbers(r[column], kind) for r in rows]) if rows else []
        out = np.full(n, empty, np.int64)
        out[level.at] = values[level.which]
        return out

    ranks = spread("ranks", np.int32, -1)
    base = np.zeros(n, np.int64)
    base[level.at] = offsets[level.ranges[level.which]]
    return level._replace(totals=spread("totals", np.int64, 0), kept=spread("kept", np.int8, 0),
                          states=np.where(ranks >= 0, base + ranks, -1))


def walk(shard: dict, answers: list[dict], offsets: dict[int, np.ndarray], rule: Rule) -> Iterator[Level]:
    """The levels of a shard as far as they are answered, then the next one."""
    by_level = defaultdict(list)
    for row in answers:
        by_level[row["level"]].append(row)
    ids = numbers(shard["ids"], np.int32)
    own = numbers(shard["keys"], np.uint64)
    order, n = np.argsort(own), len(ids)
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    nothing = np.full(n, -1, np.int64)
    level = Level(0, own[order], order, np.arange(n), place[ids], dealt(own[order], rule.ranges), np.arange(len(own)), nothing, nothing)
    word = None
    while True:
        if level.number not in offsets:
            yield level
            return
        level = answered(level, by_level[level.number], offsets[level.number])
        yield level
        word = level.states if word is None else word
        context, weight = nothing.copy(), np.zeros(n, np.int64)
        fit = level.totals[:-1] >= rule.least
        context[1:] = np.where(fit & (ids[:-1] != 0), level.states[:-1], -1)
        weight[1:] = level.totals[:-1]
        mask = context >= 0
        if rule.suffix:
            mask &= (word >= 0) & (level.states >= 0)
        at = np.flatnonzero(mask)
        symbol = np.where(word[at] < 0, UNKNOWN, word[at]).astype(np.uint64)
        keys, first, which = np.unique(
            (context[at].astype(np.uint64) << np.uint64(32)) | symbol, return_index=True, return_inverse=True)
        hot = weight[at][first] > rule.hot
        ranges = dealt(mixed(np.where(hot, keys, keys >> np.uint64(32))), rule.ranges) + np.where(hot & (rule.hot > 0), rule.ranges, 0)
        level = Level(level.number + 1, keys, at[first], at, which, ranges, np.argsort(ranges, kind="stable"), context, weight)


def ask(shard: int, level: Level, counts: np.ndarray, priors: np.ndarray | None = None) -> pa.Table:
    """One row per range that the level's arcs fall into. counts and priors are per arc, in the order of keys."""
    ranges = level.ranges[level.order]
    starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]][: len(ranges)])
    bounds = [*starts, len(ranges)]
    cut = [level.order[a:b] for a, b in zip(bounds, bounds[1:])]
    return pa.table({
        "p": pa.array(ranges[starts].astype(np.int32)), "shard": pa.array([shard] * len(cut), pa.int64()),
        "keys": pa.array([steps(level.keys[c]) for c in cut], pa.binary()),
        "counts": pa.array([planes(counts[c].astype(np.int32)) for c in cut], pa.binary()),
        "priors": pa.array([None if priors is None else planes(priors[c].astype(np.float32)) for c in cut], pa.binary())})


class Union(NamedTuple):
    """The arcs of one range. keys, totals: united and summed; first: an asked place of each, in the smallest shard that has
    it; which: the united arc of each asked one; ends: where each shard's arcs end."""

    p: int
    shards: list[int]
    keys: np.ndarray
    totals: np.ndarray
    first: np.ndarray
    which: np.ndarray
    ends: np.ndarray
    priors: np.ndarray | None


def unite(rows: pa.Table) -> Union:
    rows = rows.sort_by("shard")
    lists = [from_steps(x.as_py()) for x in rows["keys"]]
    asked = np.concatenate(lists)
    keys, first, which = np.unique(asked, return_index=True, return_inverse=True)
    counts = np.concatenate([numbers(x.as_py(), np.int32) for x in rows["counts"]])
    totals = np.bincount(which, counts, len(keys)).astype(np.int64)  # doubles, exact below 2 ** 53
    priors = None
    if rows["priors"].null_count == 0:
        priors = np.concatenate([numbers(x.as_py(), np.float32) for x in rows["priors"]])[first].astype(np.float64)
    return Union(rows["p"][0].as_py(), rows["shard"].to_pylist(), keys, totals, first, which,
                 np.cumsum([len(x) for x in lists]), priors)


def answer(level: int, union: Union, least: int, kept: np.ndarray, extra: Sequence[dict] = (), reply: bool = True) -> pa.Table:
    """A row per shard that asked, if they are to have a reply, and one with the range's figures and states. kept is per
    asked arc."""
    heavy = union.totals >= least
    ranks = np.where(heavy, np.cumsum(heavy) - 1, -1).astype(np.int32)
    rows = []
    for shard, start, end in zip(union.shards, [0, *union.ends[:-1]], union.ends, strict=True) if reply else ():
        which = union.which[start:end]
        rows.append({"shard": shard, "totals": planes(union.totals[which]), "ranks": planes(ranks[which]),
                     "kept": planes(kept[start:end].astype(np.int8))})
    rows.append({"keys": steps(union.keys[heavy]), "totals": planes(union.totals[heavy]), "n": int(union.totals.sum()),
                 "v": int((union.totals > 0).sum()), "ranked": int(heavy.sum())})
    schema = pa.schema([
        ("level", pa.int32()), ("shard", pa.int64()), ("p", pa.int32()), ("totals", pa.binary()), ("ranks", pa.binary()),
        ("kept", pa.binary()), ("keys", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("ranked", pa.int64())])
    return pa.Table.from_pylist([{"level": level, "p": union.p} | r for r in [*rows, *extra]], schema)


def ranges_of(rows: DataFrame) -> int:
    return 2 * shuffle_partitions(rows.sparkSession)


def offsets(answers: DataFrame, ranges: int) -> tuple[np.ndarray, int, int]:
    """(number of the first state of each range, all weights, all arcs that have one): a row per range."""
    found = answers.filter("ranked is not null").select("p", "ranked", "n", "v").collect()
    sizes = np.zeros(ranges, np.int64)
    for r in found:
        sizes[r["p"]] = r["ranked"]
    if sizes.sum() >= UNKNOWN:
        raise ValueError("over four billion states in one level")
    return np.cumsum(sizes) - sizes, sum(r["n"] for r in found), sum(r["v"] for r in found)


def dictionary(shard: dict, answers: list[dict], offsets: np.ndarray, ranges: int) -> Level:
    """Level 0 with a place per word of the shard's dictionary."""
    own = numbers(shard["keys"], np.uint64)
    order, every = np.argsort(own), np.arange(len(own))
    place = np.empty(len(own), np.int64)
    place[order] = every
    level = Level(0, own[order], order, every, place, dealt(own[order], ranges), every, every, every)
    return answered(level, answers, offsets)


def states(answers: DataFrame, first: np.ndarray) -> DataFrame:
    """(state, source, word, total) of every state of a level; of level 0, source and word have no meaning."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, totals = from_steps(row["keys"]), numbers(row["totals"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[row["p"]] + np.arange(len(keys))), pa.array((keys >> np.uint64(32)).astype(np.int64)),
                     pa.array((keys & np.uint64(UNKNOWN)).astype(np.int64)), pa.array(totals)],
                    ["state", "source", "word", "total"])

    return answers.filter(F.col("ranked") > 0).select("p", "keys", "totals").mapInArrow(
        of, "state long, source long, word long, total long")


def meet(shard_rows: DataFrame, answers: list[DataFrame], work: Callable[[dict, list[dict]], pa.Table], schema: str) -> DataFrame:
    """work(shard, its answers) for every shard; _who is who as an Arrow array."""
    replies = answers[0]
    for more in answers[1:]:
        replies = replies.unionByName(more)
    replies = replies.filter("shard is not null").select("level", "shard", "p", "totals", "ranks", "kept")

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = left.to_pylist()[0]
        if "who" in shard:
            shard["_who"] = left["who"][0].values
        return work(shard, right.to_pylist())

    return shard_rows.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(of, schema)
