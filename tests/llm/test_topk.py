"""Exact top-k against all products."""

import math
import random

import pytest

from anchorage.llm import topk


def brute(rows, k=5):
    v = [(i, [math.floor(256 * float(c)) for c in e]) for i, e in rows if i is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    for i in sorted({i for i, _ in v if i % 50 == 0}):
        q = min(e for j, e in v if j == i)
        s = sorted(((-sum(a * b for a, b in zip(q, e)), j) for j, e in v if j != i))[:k]
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, 0.0) for i, e in rows], "vec_id long, embedding array<float>, rank int, score double")


@pytest.mark.parametrize("block", [4096, 32])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(block)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.125, 0.7, 2.0]) * (1 if i % 7 else 3) for _ in range(24)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000 + i, [0.0] * 24) for i in range(20)]
    rows += [(50, None), (3, [1.0, None]), (100, [float("nan")] * 24), (150, [float("inf")] + [0.0] * 23), (None, [1.0] * 24), (3000, []), (3050, [5.0] * 3)]
    rows = [r if r[1] is None or len(r[1]) != 24 else (r[0], [float(x) for x in r[1]]) for r in rows]
    import numpy as np

    rows = [(i, None if e is None else [None if c is None else float(np.float32(c)) for c in e]) for i, e in rows]
    got = topk.top_k(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_few(spark):
    assert topk.top_k(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, [(0, [1.0])])).count() == 0
    assert [tuple(r) for r in topk.top_k(frame(spark, [(0, [1.0]), (1, [2.0])])).collect()] == [(0, 1, 1, 131072)]
