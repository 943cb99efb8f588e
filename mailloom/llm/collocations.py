"""Collocations: phrases whose words stand together more often than their parts would suggest.

Phrases are the states of a counted automaton (`arcs`): shards build the arcs of their word sequences, sorted and summed,
and ranges of arcs unite those of all shards and add up the weights. Level by level, an arc is followed only from a phrase that
occurs often enough, over a word that does, and whose last words do; no frequent phrase is lost by that, as a phrase
occurs at most as often as its parts.

Parts are looked up by composing the automaton with itself: the state of a phrase without its first word is where the
arc of its last word leads from the state of its source without its first word. Each level so joins itself to the one
below, twice, and takes over the weights of the parts of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm import arcs
from mailloom.llm.arcs import BREAK, Rule
from mailloom.llm.common import stored, text_of

LEAST, LONGEST, MOST = 30, 4, 2000
#: A phrase goes if a longer one has this share of its occurrences, in hundredths.
SWALLOWED = 80
SCALE = 2_000_000
#: Rows of a language are ranked in so many parts before they are ranked together.
PARTS = 64
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + BREAK * len(ENDS) + b" ")


def cut(text: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case, and BREAK after each piece."""
    return text.translate(TABLE).replace(BREAK, b" " + BREAK + b" ").split() + [BREAK]


def counted(docs: DataFrame, text_col: str, lang_col: str, least: int, longest: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(lang, n), (state, lang, word) of frequent words, and the states of each level."""
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("who"), F.lit(True).alias("train"),
                       text_of(docs[text_col]).cast("binary").alias("text"))
    shards = stored(arcs.shards(rows, cut, per_who=True), "shards")
    ranges = arcs.ranges_of(docs)
    rule = Rule(ranges, least, least, suffix=True)
    sizes = shards.select(F.explode(F.arrays_zip("who", "words")).alias("x")).groupBy(F.col("x.who").alias("lang")).agg(
        F.sum(F.col("x.words").cast("long")).alias("n"))
    firsts: dict[int, np.ndarray] = {}

    def words(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                level = next(arcs.walk(shard, [], {}, rule))
                counts = arcs.numbers(shard["counts"], np.int32).copy()
                counts[0] = 0  # a break is no word
                yield from arcs.ask(shard["shard"], level, counts[level.first]).to_batches()

    def longer(shard: dict, answers: list[dict]) -> pa.Table:
        *_, level = arcs.walk(shard, answers, firsts, rule)
        return arcs.ask(shard["shard"], level, np.bincount(level.which, minlength=len(level.keys)))

    def united(number: int):
        def of(rows: pa.Table) -> pa.Table:
            union = arcs.unite(rows)
            first = union.first[union.which] == np.arange(len(union.which))
            return arcs.answer(number, union, least, first, reply=number < longest - 1)
        return of

    levels: list[DataFrame] = []
    for number in range(longest):
        if number:
            asked = arcs.meet(shards.select("shard", "ids", "keys"), levels, longer, arcs.ASKS)
        else:
            asked = shards.select("shard", "ids", "keys", "counts").mapInArrow(words, arcs.ASKS)
        levels.append(stored(asked.groupBy("p").applyInArrow(united(number), arcs.ANSWERS), f"level{number}"))
        firsts[number] = arcs.offsets(levels[-1], ranges)[0]

    def named(shard: dict, answers: list[dict]) -> pa.Table:
        level = arcs.dictionary(shard, answers, firsts[0], ranges)
        chosen = np.flatnonzero((level.kept > 0) & (level.states >= 0))
        owners = arcs.numbers(shard["owners"], np.int32)
        return pa.table({
            "state": pa.array(level.states[chosen]), "lang": pa.array([shard["who"][owners[i]] for i in chosen], pa.string()),
            "word": pa.array([shard["names"][i].decode() for i in chosen], pa.string())})

    names = arcs.meet(shards.select("shard", "keys", "owners", "names", "who"), levels[:1], named,
                      "state long, lang string, word string")
    return sizes, names, [arcs.states(level, firsts[i]) for i, level in enumerate(levels)]


def composed(states: DataFrame, below: DataFrame, first: bool) -> DataFrame:
    """States of a level with their phrase, the weights of their first and of their last words, and their suffix."""
    source = below.select(F.col("state").alias("source"), "lang", "head", F.col("a").alias("source_a"),
                          F.col("heads").alias("source_heads"), F.col("suffix").alias("source_suffix"))
    rows = states.join(source, "source")
    last = below.select(F.col("state").alias("suffix"), F.col("source").alias("source_suffix"), "word", "phrase",
                        F.col("a").alias("suffix_a"), F.col("tails").alias("suffix_tails"))
    if first:  # what follows the first word is the word itself
        last = last.withColumn("word", F.col("suffix")).drop("source_suffix")
        rows = rows.drop("source_suffix").join(last, "word")
    else:
        rows = rows.join(last, ["source_suffix", "word"])
    return rows.select(
        "state", "source", "word", F.col("total").alias("a"), "lang", "head", "suffix",
        F.concat_ws(" ", "head", "phrase").alias("phrase"),
        F.concat("source_heads", F.array("source_a")).alias("heads"),
        F.concat(F.array("suffix_a"), "suffix_tails").alias("tails"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 longest: int = LONGEST, swallowed: int = SWALLOWED) -> DataFrame:
    """Every phrase of 2 to `longest` words that occurs `least` times in a language: lang, phrase, words, a (its
    occurrences), k (the cut with the lowest score, the first of several), l and r (occurrences of the parts), n (all words of
    the language), score = floor(2000000 a / (l + r)), and kept: whether no longer phrase that holds it, word for word, has
    `swallowed` hundredths of its occurrences.

    A-Z counts as a-z; pieces end at `.,;:!?` and line ends; words at spaces and tabs. A null language is `und`, a null
    text is empty. Repeated rows count each time. An empty table gives no rows; other columns aren't looked at.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have 2 words and occur once at least")
    sizes, names, levels = counted(docs, text_col, lang_col, least, longest)
    words = levels[0].select("state", F.col("total").alias("a")).join(names, "state")
    below = stored(words.select(
        "state", F.lit(None).cast("long").alias("source"), F.col("state").alias("word"), "a", "lang", F.col("word").alias("head"),
        F.lit(None).cast("long").alias("suffix"), F.col("word").alias("phrase"),
        F.array().cast("array<bigint>").alias("heads"), F.array().cast("array<bigint>").alias("tails")), "words")
    found = []
    for number in range(1, longest):
        below = stored(composed(levels[number], below, number == 1), f"phrases{number}")
        found.append(below)
    out = None
    for number, level in enumerate(found, 1):
        longer = None
        if number < len(found):  # those of two more words hold one of one more word that is at least as frequent
            above = found[number]
            longer = above.select(F.col("source").alias("state"), "a").unionByName(
                above.select(F.col("suffix").alias("state"), "a")).groupBy("state").agg(F.max("a").alias("most"))
            level = level.join(longer, "state", "left")
        else:
            level = level.withColumn("most", F.lit(None).cast("long"))
        cuts = F.transform(F.sequence(F.lit(1), F.lit(number)), lambda k: F.struct(
            k.alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", k).alias("r")))
        level = level.withColumn("cut", F.array_min(F.transform(cuts, lambda c: F.struct(
            F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(SCALE), (c["l"] + c["r"]).cast("decimal(20,0)"))
            .cast("long").alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))))
        level = level.select(
            "lang", "phrase", F.lit(number + 1).alias("words"), "a", "cut.*",
            (F.coalesce(F.lit(100) * F.col("most"), F.lit(-1)) < F.lit(swallowed) * F.col("a")).alias("kept"))
        out = level if out is None else out.unionByName(level)
    return out.join(sizes, "lang")


def top(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST, **options) -> DataFrame:
    """Each language's first `most` kept phrases by score, then occurrences, then phrase: lang, rank, phrase, a, l, r, n,
    score, k. A language's rows are ranked in parts first, so no task gets all of them."""
    kept = collocations(docs, text_col, lang_col, **options).filter("kept")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = kept.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= most).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "k")
