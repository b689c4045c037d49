"""Change points against all cuts, and against a plain table of prefixes."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest

from anchorage.llm import changes


def price(x):
    n, s, q = len(x), sum(x), sum(v * v for v in x)
    v = 1 + (n * q - s * s) // (n * n)
    return v, n * math.floor(1000 * math.log(v))


def all_cuts(x, least, penalty):
    """Every way to cut; the best by cost, then segments, then starts from the last backwards."""
    n, best = len(x), None
    for m in range(max(1, n // least)):
        for cuts in itertools.combinations(range(least, n - least + 1), m):
            ends = [0, *cuts, n]
            if m and min(z - a for a, z in itertools.pairwise(ends)) < least:
                continue
            cost = sum(price(x[a:z])[1] for a, z in itertools.pairwise(ends)) + penalty * m
            if best is None or (cost, m, ends[-2::-1]) < best[0]:
                best = (cost, m, ends[-2::-1]), ends
    return best[1], best[0][0]


def table(x, least, penalty):
    """Dynamic programming over prefixes with whole paths as keys."""
    n = len(x)
    if n < 2 * least:
        return [0, n], price(x)[1]
    best = {0: (0, 0, [])}
    for z in [*range(least, n - least + 1), n]:
        found = [(best[a][0] + price(x[a:z])[1] + (penalty if a else 0), best[a][1] + 1, [a, *best[a][2]]) for a in best if z - a >= least]
        if found:
            best[z] = min(found)
    return [*best[n][2][::-1], n], best[n][0]


def series(x, first=0):
    days = np.array([first, *[first + i for i, v in enumerate(x) if v and 0 < i < len(x) - 1], first + len(x) - 1][: max(1, len(x))])
    if len(x) == 1:
        days = days[:1]
    return changes.Series(days, np.array([x[d - first] for d in days], dtype=np.int64))


@pytest.mark.parametrize("seed", range(6))
def test_against_all_cuts(seed):
    rng = random.Random(seed)
    many, want = [], []
    for _ in range(60):
        n, level = rng.randint(1, 16), 5
        x = []
        for _ in range(n):
            level = rng.choice([0, 3, 40]) if rng.random() < 0.3 else level
            x.append(max(0, level + rng.choice([0, 0, 1, 2])))
        least, penalty = 3, 700
        many.append(series(x, 100))
        want.append((x, *all_cuts(x, least, penalty)))
        assert table(x, least, penalty) == want[-1][1:]
    for s, (x, ends, cost) in zip(changes.segments(many, 3, 700), want, strict=True):
        assert [r[1] - 100 for r in s] + [len(x)] == ends and s[0][7] == cost
        assert [(r[3], r[4], r[5]) for r in s] == [(sum(x[a:z]), *price(x[a:z])) for a, z in itertools.pairwise(ends)]


@pytest.mark.parametrize("scale", [1, 10**9])
def test_against_prefixes(scale):
    rng = random.Random(scale)
    many, want = [], []
    for _ in range(12):
        x = [max(0, round(rng.gauss(200 + 150 * (i // rng.choice([17, 30, 64]) % 2), 30))) * scale + rng.choice([0, 1]) for i in range(rng.randint(1, 150))]
        x[0] = x[0] or 1
        x[-1] = x[-1] or 1
        many.append(series(x))
        want.append((x, *table(x, 7, 20000)))
    for s, (x, ends, cost) in zip(changes.segments(many, 7, 20000), want, strict=True):
        assert [r[1] for r in s] + [len(x)] == ends and (s[0][6], s[0][7]) == (len(ends) - 1, cost)


def test_ties():
    # All cuts of a constant series cost nothing but the penalty: one segment. Without penalty still the fewest.
    (s,) = changes.segments([series([5] * 40)], 7, 0)
    assert [r[:3] for r in s] == [(1, 0, 40)]
    # Two equal levels with a plateau between them: equal costs go to the earliest start of the last segment.
    x = [0, 0, 0, 0, 9, 9, 9, 9]
    assert table(x, 3, 1) == all_cuts(x, 3, 1)


def rows(spark, data):
    at = lambda d: None if d is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=d % 24)
    return spark.createDataFrame([(v, q, f, at(d), 7, 0) for v, q, f, d in data], "vendor_id long, quantity int, flag string, shipped_at timestamp_ntz, day long, total int")


def test_sales(spark):
    rng = random.Random(5)
    data = [(v, rng.randint(1, 50) * (1 + 9 * (d // 40 % 2 and v % 2)), "kept", d) for v in range(9) for d in range(v, 130) for _ in range(rng.randint(0, 3))]
    data += [(None, 4, "kept", 3), (None, 5, "kept", 3), (50, 1, "kept", 0), (50, 1, "kept", 12), (50, 1, "kept", 13), (51, -3, "kept", 2)]
    data += data[:400]
    broken = [(1, 5, "returned", 300), (1, None, "kept", 301), (1, 5, "kept", None), (1, 5, None, 302), (60, 5, "swapped", 1)]
    got = {}
    for r in changes.sales_changes(rows(spark, data + broken)).collect():
        got.setdefault(r["vendor_id"], []).append(r)
    days = {}
    for v, q, _, d in data:
        days.setdefault(v, {}).setdefault(d, []).append(q)
    assert set(got) == set(days)
    base = datetime.date(2024, 1, 1).toordinal() - datetime.date(1970, 1, 1).toordinal()
    for v, by in days.items():
        x = [sum(by.get(d, [0])) for d in range(min(by), max(by) + 1)]
        ends, cost = table(x, 7, 20000)
        found = sorted(got[v], key=lambda r: r["segment_no"])
        want = [(i + 1, base + min(by) + a, z - a, sum(x[a:z]), *price(x[a:z]), len(ends) - 1, cost) for i, (a, z) in enumerate(itertools.pairwise(ends))]
        assert [tuple(r)[1:] for r in found] == want


def test_empty(spark):
    assert changes.sales_changes(rows(spark, [])).count() == 0
    assert changes.sales_changes(rows(spark, [(1, None, "kept", 1)])).count() == 0
