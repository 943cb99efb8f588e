"""Targets, draws and the splitting tree."""

import random
import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from mailloom.llm import mixing


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    found, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if weight[n] * level > most * sizes[n]}
        if not over:
            return found | {n: weight[n] * level for n in open_}
        for n in over:
            found[n] = float(most * sizes[n])
            left -= found[n]
        open_ -= over
    return found


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def corpus(spark):
    """One source with most of the rows, small ones that hit their cap, a null one, one without words."""
    rows = []
    for i in range(1200):
        source = "big" if i % 3 else ("a", "b", None, "tiny", "zero")[i // 3 % 5]
        n = 0 if source == "zero" else 3 if source == "tiny" else i * 7 % 90
        rows.append((i, None if i % 50 == 0 else " ".join(["w"] * n), source))
    rows += rows[5:9]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_targets_and_takes(corpus):
    rows = corpus.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += words(r.text)
    want = filled(sizes)
    source = {r.doc_id: r.source for r in rows}
    mix = mixing.mix(corpus, shards=8)
    found = mix.takes().collect()
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        name = source[r.doc_id]
        assert (r.source_size, r.target) == (sizes[name], pytest.approx(want[name]))
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3 and len(r.shards) == r.copies
        taken[name] += r.taken
    for name, target in want.items():
        assert taken[name] == pytest.approx(target, rel=0.02, abs=3)
    again = mixing.mix(corpus.repartition(7), shards=8).takes().collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    texts = Counter((r.doc_id, r.text) for r in mix.documents(corpus).collect())
    assert sum(texts.values()) == sum(r.copies for r in found)


@pytest.fixture(scope="module")
def uneven(spark):
    """Sources of some thousand documents, a few of which have a hundred times as many words as the others."""
    rng = random.Random(7)
    rows = []
    for i in range(4000):
        n = 30_000 if i % 500 == 3 else rng.randint(5, 120)
        rows.append((i, " ".join(["w"] * n), f"s{i % 8 // 3}"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_long_documents_do_not_move_the_targets(uneven, seed):
    source = {r.doc_id: r.source for r in uneven.select("doc_id", "source").collect()}
    taken, target = Counter(), {}
    for r in mixing.mix(uneven, shards=4, seed=seed).takes().collect():
        assert r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    for name, want in target.items():
        assert taken[name] == pytest.approx(want, rel=0.001), name


def test_many_sources_are_joined_by_shuffles(corpus, monkeypatch):
    few = sorted(map(str, mixing.mix(corpus, shards=4).takes().collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(str, mixing.mix(corpus, shards=4).takes().collect())) == few


def test_hypergeometric_probabilities(spark):
    good, other, draws, n = 7, 12, 6, 4000
    frame = spark.range(n).select(mixing.hypergeometric(
        F.lit(good), F.lit(other), F.lit(draws), (F.col("id") + 0.5) / n).alias("x"))
    found = Counter(r.x for r in frame.collect())
    for k in range(draws + 1):
        p = comb(good, k) * comb(other, draws - k) / comb(good + other, draws)
        assert found[k] / n == pytest.approx(p, abs=1.5 / n)


def test_tree_keeps_quotas(spark):
    quotas = {"a": 1000, "b": 1, "c": 0, "d": 313}
    frame = spark.createDataFrame(list(quotas.items()), "_name string, draws long")
    rows = mixing.split_tree(frame, 16, 1).collect()
    sums, shards = Counter(), Counter()
    for r in rows:
        assert r.quota >= 0
        sums[r._name] += r.quota
        shards[r.shard] += r.quota
    assert {k: sums[k] for k in quotas} == quotas
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == 16


def test_awkward(awkward):
    found = mixing.mix(awkward, shards=2).takes().collect()
    assert len(found) == awkward.count()
    assert all(r.taken <= 3 * r.size for r in found)
    rows = mixing.mix(awkward, shards=2).documents(awkward)
    assert rows.columns == awkward.columns
    assert rows.count() == sum(r.copies for r in found)


def test_nothing_and_no_words(spark, nothing):
    assert mixing.mix(nothing).takes().count() == 0
    assert mixing.mix(nothing).documents(nothing).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(empty).takes().collect()] == [(0.0, 0)] * 2
