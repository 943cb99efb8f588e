"""Removal of repeated passages against brute force."""

import hashlib
import random
import re

import pytest

from mailloom.llm import substrings


def brute(rows, window):
    seen, found = {}, {}
    for key in sorted({(i is None, i or 0, t or "") for i, t in rows}):
        words = re.findall(r"[^\x20\x09-\x0D]+", key[2])
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            part = tuple(words[at: at + window])
            if part in seen:
                gone[at: at + window] = [True] * window
            seen[part] = True
        kept = " ".join(w for w, x in zip(words, gone) if not x)
        found[key] = (len(words), sum(gone), hashlib.sha256(kept.encode()).digest())
    return sorted((str(i), *found[(i is None, i or 0, t or "")]) for i, t in rows)


def same(frame, window=20, **options):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    found = substrings.remove_repeats(frame, window=window, **options).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept_digest)) for r in found) == brute(rows, window)


def test_awkward(awkward):
    # Rows that share an identifier but not the text are ordered by a hash, so leave them out of this comparison.
    same(awkward.filter("doc_id is not null and not text like 'another%'"))


def test_every_row_is_answered(awkward):
    assert substrings.remove_repeats(awkward).count() == awkward.count()


@pytest.mark.parametrize("window, anchor, seed", [(20, 6, 1), (5, 2, 2), (3, 3, 3), (1, 1, 4)])
def test_random_texts(spark, small_batches, window, anchor, seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    passages = [some(25) for _ in range(3)]
    rows = []
    for i in range(120):
        parts = [rng.choice([some(rng.randint(0, 30)), rng.choice(passages), "x " * rng.randint(1, 40)])
                 for _ in range(rng.randint(0, 5))]
        rows.append((i, None if i % 13 == 0 else " ".join(parts)))
    rows += rows[:20] + [(i + 1000, t) for i, t in rows[:20]] + [(None, "zz " + passages[0])]
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window, anchor=anchor)


def test_nothing(nothing):
    assert substrings.remove_repeats(nothing).count() == 0
