"""Mixing of sources to target weights.

Targets: sources share a budget of words by weight; none gets more than max_repeats times its size, and what such a
source can't use is shared again among the others.

Draws: the documents of a source are dealt into blocks by a hash, and a random permutation of its blocks is read as
often as the target asks for: whole rounds, then a part of one, whose last block is cut between documents. That fixes
the exact number of block draws of each source. A splitting tree deals them out to the output shards: each node halves
its draws among two children, and how many of each source go left is drawn from the multivariate hypergeometric
distribution, source by source, so that the outcome is one of a random shuffle of all draws, which never takes place.
A shard then takes its number of draws from each source's permutation, next to what the shards before it take, and
orders its documents by a hash. All randomness is a hash of seed and content, so reruns agree.

Only built-in column functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.common import WORD, look_up, shuffle_partitions, stored, text_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 42
SHARDS = 64
#: Documents per block that is aimed at, and most blocks of a source (bounds the windows over a source's blocks).
PER_BLOCK = 16
MAX_BLOCKS = 1 << 16
#: Rounds that fill what the cut block leaves open with several documents.
FILL_ROUNDS = 3
#: Up to this many sources their table is broadcast; beyond, it is joined by shuffles.
FEW_SOURCES = 10_000


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """_row (a struct of all columns of docs), _id, _name (a source's name, never null), _size (words) and _key (a hash
    of identifier, source and text)."""
    text = text_of(docs[text_col])
    name = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit(""))
    return docs.select(
        F.struct("*").alias("_row"), docs[id_col].alias("_id"), name.alias("_name"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), docs[id_col], name, text).alias("_key"))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """(_name, source_size, docs) -> the same with target.

    Weights repeat over the sources in the order of their names, the null source last. Sources whose cap per weight is
    low are capped; the first that isn't sets the level for all others. The windows hold one row per source.
    """
    whole = Window.orderBy(F.col("_name") == "", "_name")
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          ((F.row_number().over(whole) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeats))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "_name")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    every = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * share
    rows = rows.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                           / F.sum("weight").over(after))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "_name", "level"))).over(every)
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(level["level"], F.lit(float("inf"))))
    return rows.withColumn("target", target).select("_name", "source_size", "docs", "target")


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series eight places up, where it is exact to double precision or nearly so."""
    up = n.cast("double") + 8
    series = 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up)
    whole = up * F.log(up) - up + 0.5 * F.log(2 * math.pi * up) + series
    steps = F.lit(1.0)
    for i in range(1, 9):
        steps = steps * (n + i)
    return whole - F.log(steps)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once and named, not written out at each place of use."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def hypergeometric(good: Column, other: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` draws out of good + other are good, for u uniform in [0, 1).

    The distribution is summed from its mode outwards until u is passed. Twelve standard deviations hold all of it
    that double precision can tell from nothing.
    """
    given = F.struct(good.cast("double").alias("good"), other.cast("double").alias("other"),
                     draws.cast("double").alias("draws"), u.alias("u"))
    return let(given, lambda g: let(span(g["good"], g["other"], g["draws"]), lambda s: outwards(g, s)))


def span(good: Column, other: Column, draws: Column) -> Column:
    """The support of the distribution, its mode, and how far from the mode to look."""
    n = good + other
    low, high = F.greatest(F.lit(0.0), draws - other), F.least(good, draws)
    mode = F.least(high, F.greatest(low, F.floor((draws + 1) * (good + 1) / (n + 2)).cast("double")))
    width = F.ceil(12 * F.sqrt(draws * good * other) / F.greatest(n, F.lit(1.0))) + 12
    return F.struct(low.alias("low"), high.alias("high"), mode.alias("mode"), width.cast("double").alias("width"))


def outwards(given: Column, found: Column) -> Column:
    good, other, draws, u = (given[c] for c in ("good", "other", "draws", "u"))
    low, high, mode = (found[c] for c in ("low", "high", "mode"))
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    top = F.exp(choose(good, mode) + choose(other, draws - mode) - choose(good + other, draws))
    most = F.greatest(F.lit(1.0), F.least(found["width"], high - low))
    steps = F.sequence(F.lit(1).cast("long"), most.cast("long"))

    def step(state: Column, i: Column) -> Column:
        up, down = mode + i, mode - i
        p_up = F.when(up <= high, state["up"] * (good - up + 1) * (draws - up + 1) / (up * (other - draws + up)))
        p_up = F.coalesce(p_up, F.lit(0.0))
        p_down = F.when(down >= low, state["down"] * (down + 1) * (other - draws + down + 1)
                        / ((good - down) * (draws - down)))
        p_down = F.coalesce(p_down, F.lit(0.0))
        here = (F.when(state["found"].isNotNull(), state["found"])
                .when((p_up > 0) & (u < state["sum"] + p_up), up)
                .when((p_down > 0) & (u < state["sum"] + p_up + p_down), down))
        return F.struct((state["sum"] + p_up + p_down).alias("sum"), p_up.alias("up"), p_down.alias("down"),
                        here.cast("long").alias("found"))

    start = let(top, lambda p: F.struct(p.alias("sum"), p.alias("up"), p.alias("down"),
                                        F.when(u < p, mode).cast("long").alias("found")))
    return F.aggregate(steps, start, step, lambda state: F.coalesce(state["found"], mode.cast("long")))


def uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_name, draws) -> (_name, shard, quota): exact quotas that add up, shards of equal size to within one draw.

    A node is one row with an array of its sources' draws; there are as many as shards. shards is a power of two.
    """
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("_name", "draws"))).alias("all"))
    node = node.select(F.lit(0).cast("long").alias("node"), "all")
    for depth in range(shards.bit_length() - 1):
        total = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["draws"])
        node = node.withColumn("total", total)

        def deal(state: Column, x: Column) -> Column:
            u = uniform(F.lit(seed), F.lit(depth), F.col("node"), x["_name"])
            left = hypergeometric(x["draws"], state["rest"] - x["draws"], state["take"], u)
            return let(left, lambda n: F.struct(
                (state["rest"] - x["draws"]).alias("rest"), (state["take"] - n).alias("take"),
                F.concat(state["left"], F.array(n)).alias("left")))

        start = F.struct(F.col("total").alias("rest"), F.floor(F.col("total") / 2).alias("take"),
                         F.array().cast("array<bigint>").alias("left"))
        node = node.withColumn("left", F.aggregate("all", start, deal, lambda state: state["left"]))
        child = lambda draws: F.zip_with("all", "left", lambda x, n: F.struct(
            x["_name"].alias("_name"), draws(x["draws"], n).alias("draws")))
        node = node.select(F.explode(F.array(
            F.struct((2 * F.col("node")).alias("node"), child(lambda d, n: n).alias("all")),
            F.struct((2 * F.col("node") + 1).alias("node"), child(lambda d, n: d - n).alias("all")),
        )).alias("at")).select("at.*")
        node = stored(node, "nodes")  # else the expressions of all levels pile up in one plan
    return node.select(F.col("node").alias("shard"), F.explode("all").alias("at")).select(
        "at._name", "shard", F.col("at.draws").alias("quota"))


class Mix:
    """The decisions of a mix over docs: `sources`, `blocks`, and `cut`, which are stored, and how rows find them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS,
                 shards: int = SHARDS, seed: int = SEED):
        self.columns, self.seed = (id_col, text_col, source_col), seed
        docs = keyed(docs, *self.columns, seed)
        self.slim = stored(docs.select(F.col("_id").alias("doc_id"), "_name", "_size", "_key"), "sizes")
        sums = self.slim.groupBy("_name").agg(F.sum("_size").alias("source_size"), F.count("*").alias("docs"))
        sources = targets(sums, weights, share, max_repeats)
        full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("docs") / PER_BLOCK)).cast("long")
        self.sources = stored(sources.withColumns({"full": full.cast("long"), "n_blocks": blocks}).withColumn(
            "rest", F.col("target") - F.col("full") * F.col("source_size")), "sources")
        self.few = self.sources.count() <= FEW_SOURCES
        self.blocks, self.cut = self._draw(shards)

    def _with_source(self, rows: DataFrame) -> DataFrame:
        """rows (_name, _key) with their source's figures and _block."""
        if self.few:
            rows = rows.join(F.broadcast(self.sources), "_name")
        else:
            slot = F.pmod("_key", F.lit(max(8, shuffle_partitions(rows.sparkSession))))
            rows = look_up(rows.withColumn("_slot", slot), self.sources, ["_name"], "_slot").drop("_slot")
        return rows.withColumn("_block", F.pmod("_key", F.col("n_blocks")))

    def _draw(self, shards: int) -> tuple[DataFrame, DataFrame]:
        rows = self._with_source(self.slim)
        order = F.xxhash64(F.lit(self.seed), F.lit("block"), "_name", "_block")
        permuted = Window.partitionBy("_name").orderBy(order, "_block")
        blocks = rows.groupBy("_name", "_block", "full", "rest", "n_blocks").agg(F.sum("_size").alias("words"))
        blocks = blocks.withColumns({
            "place": F.row_number().over(permuted) - 1,
            "before": F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        })
        ends = F.col("before") + F.col("words")
        blocks = stored(blocks.withColumns({
            "gap": F.when((F.col("before") < F.col("rest")) & (ends > F.col("rest")), F.col("rest") - F.col("before")),
            "more": ((F.col("before") < F.col("rest")) & (F.col("words") > 0)).cast("long"),
        }), "blocks")
        # Blocks that are cut, at most one of each source: a run of its documents, and what fills the rest.
        docs = rows.groupBy("_name", "_block", "_key").agg(F.sum("_size").alias("words"))
        docs = stored(docs.join(blocks.select("_name", "_block", "gap", "more"), ["_name", "_block"]), "documents")
        run = Window.partitionBy("_name", "_block").orderBy(F.xxhash64(F.lit(self.seed), F.lit("cut"), "_key"), "_key")
        cut = stored(docs.filter("gap is not null").withColumn("run", F.sum("words").over(run) <= F.col("gap")), "cut")
        open_ = cut.groupBy("_name").agg(
            (F.first("gap") - F.coalesce(F.sum(F.when(F.col("run"), F.col("words"))), F.lit(0))).alias("open"))
        free = docs.filter("more = 0").unionByName(cut.filter("not run").drop("run"))
        fills = self._fill(free.select("_name", "_block", "_key", "words").filter("words > 0"), open_)
        cut = cut.filter("run").select("_name", "_block", "_key").unionByName(fills)
        # Draws of blocks: whole rounds over the permutation, then the blocks of the last round.
        draws = blocks.withColumn("round", F.explode(F.sequence(
            F.lit(0).cast("long"), F.col("full") + F.col("more")))).filter(F.col("round") < F.col("full") + F.col("more"))
        draws = draws.withColumn("at", F.col("round") * F.col("n_blocks") + F.col("place"))
        place = Window.partitionBy("_name").orderBy("at")
        draws = draws.select("_name", "_block", "round", (F.row_number().over(place) - 1).cast("long").alias("at"))
        quotas = blocks.groupBy("_name").agg(F.sum(F.col("full") + F.col("more")).alias("draws"))
        dealt = split_tree(quotas, shards, self.seed)
        before = Window.partitionBy("_name").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0))).filter("quota > 0")
        dealt = dealt.select("_name", "shard", F.explode(
            F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("at"))
        by_block = draws.join(dealt, ["_name", "at"]).groupBy("_name", "_block").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("round", "shard"))), lambda x: x["shard"]).alias("shards"))
        blocks = blocks.select("_name", "_block", "more", F.col("gap").isNotNull().alias("is_cut"))
        drawn = stored(blocks.join(by_block, ["_name", "_block"], "left"), "drawn")
        where = drawn.filter("is_cut").select("_name", F.element_at("shards", -1).alias("_shard"))
        return drawn, stored(cut.join(F.broadcast(where) if self.few else where, "_name"), "parts")

    def _fill(self, free: DataFrame, open_: DataFrame) -> DataFrame:
        """Documents out of free (_name, _block, _key, words) whose words come near what is open (_name, open).

        Each round leaves aside what is longer than what is still open, and of the rest takes documents block after
        block in permuted order as long as they fit. What no document fits into is left to the one that comes nearest.
        """
        few = F.broadcast if self.few else lambda df: df
        order = F.xxhash64(F.lit(self.seed), F.lit("fill"), "_name", "_block")
        earlier = Window.partitionBy("_name").orderBy(order, "_block").rowsBetween(Window.unboundedPreceding, -1)
        run = Window.partitionBy("_name", "_block").orderBy(F.xxhash64(F.lit(self.seed), F.lit("fill"), "_key"), "_key")
        keys, fills = ["_name", "_block", "_key"], []
        open_ = stored(open_.withColumn("open", F.col("open").cast("double")), "open")
        for _ in range(FILL_ROUNDS):
            fits = free.join(few(open_), "_name").filter(F.col("words") <= F.col("open"))
            blocks = fits.groupBy("_name", "_block", "open").agg(F.sum("words").alias("sum"))
            blocks = blocks.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
            within = fits.drop("open").join(blocks.filter("before < open").drop("sum"), ["_name", "_block"])
            within = within.withColumn("end", F.col("before") + F.sum("words").over(run)).filter("end <= open")
            taken = stored(within.select(*keys, "words"), "fill")
            fills.append(taken)
            free = free.join(taken.select(*keys), keys, "left_anti")
            sums = taken.groupBy("_name").agg(F.sum("words").alias("sum"))
            open_ = stored(open_.join(few(sums), "_name", "left").select(
                "_name", (F.col("open") - F.coalesce("sum", F.lit(0))).alias("open")), "open")
        nearest = F.min(F.struct(F.abs(F.col("words") - F.col("open")).alias("off"), "_key", "_block", "open")).alias("best")
        last = free.join(few(open_), "_name").groupBy("_name").agg(nearest).filter("best.off < best.open")
        found = last.select("_name", "best._block", "best._key")
        for taken in fills:
            found = found.unionByName(taken.select(*keys))
        return found

    def decide(self, rows: DataFrame) -> DataFrame:
        """rows (_name, _key) with copies (times taken) and shards (where to, one for each copy)."""
        rows = self._with_source(rows).join(self.blocks, ["_name", "_block"])
        rows = rows.join(self.cut, ["_name", "_block", "_key"], "left")
        times = F.col("full") + F.when(F.col("is_cut"), 0).otherwise(F.col("more"))
        whole = F.when(times > 0, F.slice("shards", F.lit(1), F.greatest(times, F.lit(1)).cast("int")))
        none = F.array().cast("array<bigint>")
        part = F.when(F.col("_shard").isNotNull(), F.array("_shard")).otherwise(none)
        rows = rows.withColumn("shards", F.concat(F.coalesce(whole, none), part))
        return rows.withColumn("copies", F.size("shards").cast("long"))

    def takes(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken (words), copies, shards."""
        return self.decide(self.slim).select(
            "doc_id", F.col("_size").alias("size"), "source_size", "target",
            (F.col("_size") * F.col("copies")).alias("taken"), "copies", "shards")

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix itself: each row of docs as often as it is taken, shard after shard, shuffled within each."""
        taken = self.decide(self.slim).filter("copies > 0").select("_key", "shards").dropDuplicates(["_key"])
        rows = keyed(docs, *self.columns, self.seed).select("_row", "_key").join(taken, "_key")  # one shuffle of texts
        rows = rows.select("_row", "_key", F.posexplode("shards").alias("_copy", "_shard"))
        order = F.xxhash64(F.lit(self.seed), F.lit("order"), "_key", "_copy")
        n = shuffle_partitions(docs.sparkSession)
        return rows.repartition(n, "_shard").sortWithinPartitions("_shard", order).select("_row.*")


def mix(docs: DataFrame, **options) -> Mix:
    """A mix of docs. Each source's taken words come near its target, and no document is taken over max_repeats times.

    A null text has size 0; a null source is a source of its own, the last one. Rows that repeat in identifier,
    source and text are taken alike. Documents without words are never taken in part rounds but come along in whole ones. A table
    without words has targets of 0; an empty one gives no rows. Extra columns are kept and don't matter,
    whatever their names.
    """
    return Mix(docs, **options)
