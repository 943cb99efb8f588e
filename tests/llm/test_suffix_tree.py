"""Suffix-tree scores against a plain tree."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailloom.llm import arcs, suffix_tree
from mailloom.llm.suffix_tree import Parameters


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows, depth=2, least=16, prior=12.0, divergence=6.0):
    """rows (id, text, held out) -> sorted rows of the result; the tree is built context by context."""
    counts, words = defaultdict(Counter), Counter()
    for _, text, held in rows:
        if not held:
            t = tokens(text)
            words.update(t)
            for d in range(1, depth + 1):
                for i in range(d, len(t)):
                    counts[tuple(t[i - d: i])][t[i]] += 1
    n, v = sum(words.values()), len(words)
    states = set()

    def p(context, token):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (words[token] + 1) / (n + v + 1)
        c = counts[context]
        return (c[token] + prior * p(context[1:], token)) / (sum(c.values()) + prior)

    for context in sorted(counts, key=len):
        c = counts[context]
        total = sum(c.values())
        if total >= least:
            gain = -total * math.log(total - 1 + prior)
            for token, k in c.items():
                q = float(np.float32(p(context[1:], token)))
                gain += k * (math.log(k - 1 + prior * q) - math.log(q))
            if gain > divergence:
                states.add(context)
    out = []
    for i, text, held in rows:
        t = tokens(text)
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in t)
        own = sum(math.log10(p(tuple(t[max(0, j - depth): j]), x)) for j, x in enumerate(t))
        out.append((str(i), bool(held), len(t), sum(words[x] > 0 for x in t), n, base, own))
    return sorted(out, key=str), states


def same(found, want):
    found = sorted(((str(r[0]), *r[1:]) for r in found.collect()), key=lambda r: (r[0], r[1], r[2], -r[5]))
    want = sorted(want, key=lambda r: (r[0], r[1], r[2], -r[5]))
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("options", [
    Parameters(), Parameters(depth=3, least=3, prior=2.0, divergence=1.0), Parameters(depth=1, least=1, divergence=-50.0),
    Parameters(depth=3, least=4, divergence=2.0, hot_share=20, hot_least=5)])
def test_random_texts(spark, small_batches, monkeypatch, options):
    monkeypatch.setattr(arcs, "SHARD", 300)
    rng = random.Random(7)
    phrases = ["in the morning", "New york City", "as well as", "the end of the day"]
    some = lambda k: " ".join(rng.choice([*phrases, *"abcdefgh", f"rare{rng.randint(0, 500)}"]) for _ in range(k))
    rows = [(i, None if i % 17 == 0 else some(rng.randint(0, 40)), i % 5 == 0) for i in range(150)]
    rows += rows[:20] + [(None, "the end of the moon", True), (1000, "in the " * 900, False), (1001, "unheard-of words", True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(4)
    found = suffix_tree.score(frame, frame["held"], parameters=options)
    want, states = brute(rows, options.depth, options.least, options.prior, options.divergence)
    assert states or options.depth == 1
    same(found, want)


def test_awkward(spark, awkward, nothing):
    held = F.col("doc_id") % 3 == 1
    rows = [(r.doc_id, r.text, r.doc_id is not None and r.doc_id % 3 == 1) for r in awkward.collect()]
    same(suffix_tree.score(awkward, held), brute(rows)[0])
    assert suffix_tree.score(nothing, held).count() == 0
    assert {r.score for r in suffix_tree.score(awkward, F.lit(True)).collect()} == {0.0}


def test_held_out_texts_get_likelier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = suffix_tree.score(docs, held).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    base, own = (sum(getattr(r, c) for r in found if r.held_out) for c in ("base_score", "score"))
    assert own > base
