"""Average linkage by sum vectors against merging over all pairs."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest

from anchorage.operators import linkage, nil


def mentions(n, seed, groups=1, spread=0.25):
    rng = random.Random(seed)
    rows, centres = [], [[rng.gauss(0, 1) for _ in range(8)] for _ in range(max(2, n // 9))]
    for i in range(n):
        kind = "E" if rng.random() < 0.2 else "NIL"
        link = f"{kind}{rng.randrange(n):05d}-{i % groups}" if rng.random() < 0.8 else f"{kind}7-{i % groups}"
        c = centres[rng.randrange(len(centres))]
        rows.append((f"q{i}", link, f"g{i % groups}", [float(np.float32(x + rng.gauss(0, spread))) for x in c]))
    return rows


def brute(rows, cutoff):
    """The clusters by agglomerate() over the sums of all pairs of mentions."""
    out = {}
    for g in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == g]
        x = np.array([r[3] for r in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = sorted({r[1] for r in own})
        at = np.array([links.index(r[1]) for r in own])
        total = np.zeros((len(links), 8))
        np.add.at(total, at, x)
        n, s = np.bincount(at), total @ total.T
        pairs = {(links[a], links[b]): (s[a, b], n[a] * n[b]) for a, b in itertools.combinations(range(len(links)), 2)}
        into = nil.agglomerate(links, pairs, cutoff)
        out |= {r[0]: into[r[1]] for r in own}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "query_id string, kb_link string, label string, embedding array<float>")


@pytest.mark.parametrize(("task", "side"), [(4096, 4096), (0, 16), (40, 1000)])
def test_against_all_pairs(spark, monkeypatch, task, side):
    monkeypatch.setattr(linkage, "TASK", task)
    monkeypatch.setattr(linkage, "SIDE", side)
    rows = mentions(160, task + side, 3)
    got = {r.query_id: r.kb_link for r in linkage.average_link(frame(spark, rows), 0.6, "label").collect()}
    want = brute(rows, 0.6)
    assert got == want and len(set(want.values())) < 0.8 * len({r[1] for r in rows})


def test_two_thousand_of_one_label():
    rows = mentions(2000, 5, spread=0.4)
    links = sorted({r[1] for r in rows})
    x = np.array([r[3] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    total, at = np.zeros((len(links), 8)), np.array([links.index(r[1]) for r in rows])
    np.add.at(total, at, x)
    got = linkage.merge_in_task(np.array(links, dtype=object), total, np.bincount(at), 0.8)
    assert {r[0]: got[r[1]] for r in rows} == brute(rows, 0.8)


def test_what_takes_no_part(spark):
    rows = [("a", "NIL1", "g", [1.0, 0.0]), ("b", "NIL2", "g", [1.0, 0.0]), ("c", "E1", "g", [1.0, 0.1]), ("d", "E2", "g", [1.0, 0.1]), ("e", "NIL3", "g", None), ("f", "NIL4", "g", [0.0, 0.0]), ("h", "NIL5", None, [1.0, 0.0]), ("i", "NIL6", "x", [1.0, 0.0])]
    got = {r.query_id: r.kb_link for r in linkage.average_link(frame(spark, rows), 0.9, "label").collect()}
    assert got == {"a": "E1", "b": "E1", "c": "E1", "d": "E2", "e": "NIL3", "f": "NIL4", "h": "NIL5", "i": "NIL6"}
    assert linkage.average_link(frame(spark, []), 0.9).count() == 0


def test_memory_does_not_grow_with_the_clusters():
    """a task holds so many similarities at a time, whatever the number of clusters."""
    rng, n = np.random.default_rng(1), 20_000
    x = rng.normal(size=(n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([f"NIL{i:06d}" for i in range(n)], dtype=object)
    tracemalloc.start()
    near, best = linkage._nearest(ids[:600], x[:600], ids, x, -1.0)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    s = x[:600] @ x.T
    s[np.arange(600), np.arange(600)] = -np.inf
    assert (near == s.argmax(axis=1)).all() and np.abs(best - s.max(axis=1)).max() < 1e-8
