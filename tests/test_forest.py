"""Ordered folds and links against plain sequential ones."""

import random

import pytest

from rankweave.operators import forest


def sequential(folds):
    holds, into = {}, {}

    def find(x):
        while x in into:
            x = into[x]
        return x

    for _, owner, gone in sorted(folds):
        a, b = find(owner), find(gone)
        if a != b:
            into[b] = a
            holds.setdefault(a, []).extend([b, *holds.pop(b, [])])
    return {(g, a, k) for a, own in holds.items() for k, g in enumerate(own)}


def parallel(spark, folds):
    got = forest.fold_order(spark.createDataFrame(folds, "at long, owner string, gone string")).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def name(k):
    return f"r{k:03d}"


SHAPES = {
    "chain upwards": [(k, name(k), name(k + 1)) for k in range(40)],
    "chain downwards": [(100 - k, name(k), name(k + 1)) for k in range(40)],
    "star of one owner": [(k, name(0), name(k + 1)) for k in range(40)],
    "star taken over": [(k, name(k + 1), name(0)) for k in range(40)],
    "cycle": [(k, name(k % 7), name((k + 1) % 7)) for k in range(20)],
    "self and repeated": [(0, name(1), name(1)), (1, name(1), name(2)), (2, name(2), name(1)), (3, name(3), name(2)), (4, name(1), name(3))],
    "nothing": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    assert parallel(spark, SHAPES[shape]) == sequential(SHAPES[shape])


@pytest.mark.parametrize("seed", range(4))
def test_random_folds(spark, seed, monkeypatch):
    monkeypatch.setattr(forest, "MOMENTS", 7)  # many spans a key
    rng = random.Random(seed)
    n = rng.choice([10, 60])
    times = rng.sample(range(1000), 2 * n)
    folds = [(t, name(rng.randrange(n) // rng.choice([1, 3])), name(rng.randrange(n))) for t in times]
    assert parallel(spark, folds) == sequential(folds)


def test_links_are_followed_by_doubling(spark):
    links = [(k, k - 1) for k in range(1, 300)] + [(1000, 1000), (1001, 1000), (2001, 2000)]
    got = {r.node: r.root for r in forest.follow(spark.createDataFrame(links, "node long, to long")).collect()}
    assert got == {k: 0 for k in range(1, 300)} | {1000: 1000, 1001: 1000, 2001: 2000}
