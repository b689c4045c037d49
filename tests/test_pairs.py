"""Drawn pairs against all pairs."""

import itertools

import pytest

from anchorage.operators import pairs


def frame(spark, links):
    return spark.createDataFrame([(f"q{i:04d}", link, 1) for i, link in enumerate(links)], "query_id string, kb_link string, n int")


@pytest.mark.parametrize("stretch", [1 << 16, 3])
def test_all_pairs_are_numbered_once(spark, monkeypatch, stretch):
    monkeypatch.setattr(pairs, "STRETCH", stretch)
    links = [f"E{i % 5 if i % 3 else 0}" for i in range(40)] + ["NIL1", None]
    ids = [(f"q{i:04d}", x) for i, x in enumerate(links) if x]
    want = sorted((a, b, x == y) for (a, x), (b, y) in itertools.combinations(ids, 2))
    assert sorted(map(tuple, pairs.sample_pairs(frame(spark, links), negatives=1000, limit=10**6).collect())) == want


def test_sample(spark):
    links = [f"E{i % 50}" for i in range(400)]
    df = frame(spark, links)
    got = sorted(map(tuple, pairs.sample_pairs(df, limit=300).collect()))
    assert len(set(got)) == 300 and all(a < b and (links[int(a[1:])] == links[int(b[1:])]) == same for a, b, same in got)
    assert sum(same for *_, same in got) == round(300 / 11)
    assert got == sorted(map(tuple, pairs.sample_pairs(df, limit=300).collect())) != sorted(map(tuple, pairs.sample_pairs(df, 1, limit=300).collect()))
    everyone = pairs.sample_pairs(df, negatives=1, limit=10**6).collect()
    assert len(everyone) == 2 * sum(r.label for r in everyone) == 2 * 50 * 28
    assert pairs.sample_pairs(frame(spark, ["E1"])).count() == pairs.sample_pairs(frame(spark, [])).count() == pairs.sample_pairs(frame(spark, ["E1", "E2"])).count() == 0


def test_numbers_of_a_triangle():
    assert [pairs._within(o) for o in range(6)] == [(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)]
    o = 10**24 + 12345
    i, j = pairs._within(o)
    assert 0 <= i < j and j * (j - 1) // 2 + i == o
