"""Collocations against a plain count."""

import random
import re
from collections import Counter, defaultdict

import pytest

from mailloom.llm import arcs, collocations


def brute(rows, least=30, longest=4, most=2000):
    f, n, candidates = defaultdict(Counter), Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i: i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p in candidates:
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], counts[p])
        rest = []
        for p in candidates:
            a = counts[p]
            if p in inside and 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], k))
        for rank, (s, a, p, l, r, k) in enumerate(sorted(rest)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s, k))
    return sorted(out)


def check(frame, **options):
    rows = [(r.lang, r.text) for r in frame.select("lang", "text").collect()]
    want = brute(rows, **options)
    assert sorted(map(tuple, collocations.top(frame, **options).collect())) == want
    return want


def test_given_documents(spark):
    assert len(check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), least=8)) > 50


@pytest.mark.parametrize("least, longest, most", [(5, 4, 2000), (2, 5, 7), (30, 2, 2000), (1, 3, 2000)])
def test_random_texts(spark, small_batches, monkeypatch, least, longest, most):
    monkeypatch.setattr(arcs, "SHARD", 50)
    rng = random.Random(least)
    some = lambda k: " ".join(rng.choice(["a", "B", "b", "c", "é", "d\x00", "New\tYork", "x.", "y,z", "\n", "q"]) for _ in range(k))
    rows = [(rng.choice([None, "und", "en", "de", "", "a\nb"]), None if i % 9 == 0 else some(rng.randint(0, 60)), i, "s")
            for i in range(60)]
    rows += rows[:10] + [("en", "hot words here " * 200, 5, "s"), ("en", None, 7, "s"), ("xx", " .. ", 8, "s")]
    frame = spark.createDataFrame(rows, "lang string, text string, state long, word string")
    check(frame.repartition(3), least=least, longest=longest, most=most)


def test_awkward(spark, awkward, nothing):
    from pyspark.sql import functions as F
    langs = awkward.withColumn("lang", F.col("source"))
    check(langs, least=6)
    assert collocations.top(nothing.withColumn("lang", F.lit("en"))).collect() == []
