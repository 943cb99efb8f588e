"""Fingerprints, Golay keys, links and components against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from mailloom.llm import golay, simhash
from mailloom.llm.components import components


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(prints):
    """Distinct fingerprints -> the smallest (as signed) of each one's component."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            a, b = find(a), find(b)
            parent[a] = b
    members = {}
    for p in prints:
        members.setdefault(find(p), []).append(p)
    return members


def test_words_two_bits_apart_share_a_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    codes, ways = golay.decode(words)
    for a in range(23):
        for b in range(a + 1):
            others, theirs = golay.decode(words ^ (1 << a) ^ (1 << b if b < a else 0))
            for i in range(0, len(words), 50):
                assert set(codes[i, :ways[i]]) & set(others[i, :theirs[i]])
    assert set(ways) == {1, 6}


def test_fingerprints_and_components(awkward):
    rows, found = awkward.collect(), simhash.near_duplicates(awkward).collect()
    texts = {r.text or "": fingerprint(r.text) for r in rows}
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in found) == sorted(
        (str(r.doc_id), texts[r.text or ""]) for r in rows)
    ids = {}
    for r in rows:
        ids.setdefault(texts[r.text or ""], []).append(r.doc_id)
    want = {}
    for members in roots(list(ids)).values():
        real = [i for m in members for i in ids[m] if i is not None]
        want |= {m: min(real, default=None) for m in members}
    assert all(r.component_id == want[r.fp & (1 << 64) - 1] for r in found)
    kept = simhash.survivors(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len(roots(list(ids)))


@pytest.mark.parametrize("chunk", [8192, 16])
def test_a_dense_cluster_is_linked_without_all_pairs(spark, small_batches, chunk):
    rng = np.random.default_rng(3)
    prints = set()
    while len(prints) < 300:
        bits = rng.choice(64, rng.integers(0, 6), replace=False)
        prints.add(0x123456789ABCDEF ^ sum(1 << int(b) for b in bits))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3)
    links = simhash.links(frame, chunk)
    rows = links.collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in rows)
    found = {r.node: r.root for r in components(links).collect()}
    sign = lambda p: p - (1 << 64) if p >> 63 else p
    want = {sign(m): min(map(sign, ms)) for ms in roots(list(prints)).values() if len(ms) > 1 for m in ms}
    assert found == want


def test_every_pair_of_three_bits_meets(spark):
    for bits in list(combinations(range(0, 64, 3), 3)) + [(0, 30, 50), (23, 46, 1), (22, 45, 63)]:
        pair = np.array([5, 5 ^ sum(1 << b for b in bits)], np.uint64)
        keys, rows = simhash.keys_of(pair.view(np.int64))
        assert set(keys[rows == pair.view(np.int64)[0]]) & set(keys[rows == pair.view(np.int64)[1]])


def test_paths_and_stars(spark):
    rows = [(i, i + 1) for i in range(4)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (None, 3), (300, 299)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long").repartition(4)).collect()}
    assert found == ({i: 0 for i in range(5)} | {100 + i: 100 for i in range(20)} | {299: 299, 300: 299})


def test_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.survivors(nothing).count() == 0
