"""Centroid clustering against plain whole-number arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from anchorage.llm import kmeans


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(c)) for c in e]) for i, e in rows if e is not None and len(e) == 64 and all(c is not None and math.isfinite(c) and abs(c) < 131072 for c in e)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        for j, vs in own.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    got = [(i, *near(v)[::-1]) for i, v in kept] if centroids else []
    each = {}
    for _, j, d in got:
        each[j] = each.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i or 0), j, d, each[j], sum(each.values()), sha[j]) for i, j, d in got)


def run(spark, rows):
    df = spark.createDataFrame([(i, e, 9, "x", [1]) for i, e in rows], "vec_id long, embedding array<float>, cluster int, centroid string, v array<int>")
    got = kmeans.digest(kmeans.cluster(df)).collect()
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in got)


def single(e):
    return [None if c is None else float(np.float32(c)) for c in e]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, single([c + rng.gauss(0, 0.3) for c in middle[i % 5]])) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(90)] + [(3, rows[4][1]), (3, rows[3][1]), (None, rows[5][1])]
    rows += [(400, None), (401, [1.0] * 63), (402, [None] + [1.0] * 63), (403, [float("nan")] * 64), (404, [float("inf")] + [0.0] * 63), (405, []), (406, [0.0] * 65)]
    rows += [(407, [1e30] * 64), (408, single([-100000.5] * 64)), (409, [100000.0] * 64)]
    assert run(spark, rows) == brute(rows)


def test_few_and_equal(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []
    three = [(i, single([0.1 * i] * 64)) for i in range(3)]
    assert run(spark, three) == brute(three)
    same = [(i, [0.5] * 64) for i in range(40)]
    assert run(spark, same) == brute(same)
    assert {r[1] for r in run(spark, same)} == {0}


def test_screening():
    """Bounds never exceed distances, ties go to the smaller number, and most exact distances are spared."""
    rng = np.random.default_rng(4)
    c = rng.integers(-2000, 2000, (8, 64))
    c[5] = c[2]
    v = np.concatenate([c[rng.integers(0, 8, 3000)] + rng.integers(-200, 200, (3000, 64)), c])
    number, best, exact = kmeans.nearest(v, kmeans._short(v), c, kmeans._short(c))
    d = ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert exact < 0.3 * d.size
    far = np.full((2, 64), kmeans.LIMIT - 1)
    far[1] *= -1
    number, best, _ = kmeans.nearest(far, kmeans._short(far), far[::-1].copy(), kmeans._short(far[::-1].copy()))
    assert number.tolist() == [1, 0] and best.tolist() == [0, 0]
    _, best, _ = kmeans.nearest(far[:1], kmeans._short(far[:1]), far[1:], kmeans._short(far[1:]))
    assert best[0] == 64 * (2 * (kmeans.LIMIT - 1)) ** 2
