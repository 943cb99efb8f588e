"""Clustering against a full search in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from mailloom.llm import centroids


def brute(rows, clusters=16, size=64, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    means = [v for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        means = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else m for k, m in enumerate(means)]
    found = [(i, near(v)) for i, v in kept]
    total = {}
    for _, (d, k) in found:
        total[k] = total.get(k, 0) + d
    return sorted((str(i), k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, means[k])).encode()).hexdigest())
                  for i, (d, k) in found)


def rows_of(frame):
    return sorted((str(r[0]), *r[1:]) for r in frame.collect())


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-1000, 1000, (2, 30, 64))
    a, b = centroids.transform(x), centroids.transform(y)
    assert (((a - b) ** 2).sum(1) == 64 * ((x - y) ** 2).sum(1)).all()
    assert (centroids.transform(a) == 64 * x).all()
    changes = (np.diff(centroids.transform(np.eye(64)), axis=1) != 0).sum(1)
    assert changes[centroids.coarse_to_fine(64)].tolist() == list(range(64))


@pytest.mark.parametrize("spread", [1, 4, 1000])
def test_search_equals_a_full_one(spread):
    rng = np.random.default_rng(spread)
    x, c = rng.integers(-spread, spread + 1, (500, 64)), rng.integers(-spread, spread + 1, (9, 64))
    c[5], c[7] = c[2], x[0]  # ties
    x[100:200] = c[rng.integers(0, 9, 100)] + rng.integers(-1, 2, (100, 64))
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    order = centroids.coarse_to_fine(64)
    number, distance = centroids.nearest(centroids.transform(x)[:, order], centroids.transform(c)[:, order])
    assert (number == every.argmin(1)).all() and (distance == 64 * every.min(1)).all()


def test_awkward_vectors(spark, small_batches):
    rng = random.Random(3)
    some = lambda n=64: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, some()) for i in range(60)] + [(None, some())]
    rows += [(100, None), (101, []), (102, some(63)), (103, some(65)), (104, [None] + some(63)),
             (105, [float("nan")] + some(63)), (106, some(63) + [float("inf")]), (107, some(63) + [-float("inf")])]
    rows += [(200 + i, rows[0][1]) for i in range(80)] + rows[3:9] + [(300, [0.0] * 64), (301, [-0.0] * 64)]
    frame = spark.createDataFrame([(*r, 5, "x", 2) for r in rows], "vec_id long, embedding array<double>, cluster int, id string, n int")
    assert rows_of(centroids.report(frame.repartition(5))) == brute(rows)
    assert rows_of(centroids.report(frame.limit(0))) == []
    few = frame.filter("vec_id < 5")
    assert rows_of(centroids.report(few)) == brute([r for r in rows if r[0] is not None and r[0] < 5])
    same = frame.filter("vec_id >= 200 and vec_id < 300")
    assert rows_of(centroids.report(same)) == brute([r for r in rows if r[0] is not None and 200 <= r[0] < 300])


def test_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert rows_of(centroids.report(frame)) == brute(rows)


def test_components_that_are_too_large(spark):
    frame = spark.createDataFrame([(1, [1e30] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="scale the vectors down"):
        centroids.report(frame)
