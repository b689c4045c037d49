"""Places of names and interval containment against plain loops."""

import random

from anchorage.operators import occurrences


def test_every_place_is_found_once(spark):
    rows = [(1, "aaaa ab", ["aa", "ab", "aa", "", None]), (2, None, ["a"]), (3, "x", None), (4, "", ["a"]), (5, "é\U0001f600b b", ["b", "\U0001f600b"]), (6, "b", [])]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "id long, text string, names array<string>, start string")
    got = sorted(tuple(r) for r in occurrences.occurrences(df, "id", "text", "names").collect())
    want = sorted((k, n, i, i + len(n) - 1) for k, t, names in rows for n in set(names or ()) if n and t for i in range(len(t)) if t.startswith(n, i))
    assert got == want and len(got) == 7


def test_within_equals_all_pairs(spark):
    rnd = random.Random(5)
    spans = [(rnd.choice("ab"), s := rnd.randrange(-50, 5000), s + rnd.choice((0, 1, 15, 16, 17, 255, 256, 257, 4096, 70000)) , i) for i in range(300)]
    places = [(rnd.choice("abc"), s := rnd.randrange(-50, 5000), s + rnd.randrange(0, 300)) for _ in range(400)]
    places += [(k, a, b) for k, a, b, _ in spans[:50]] + [places[0], ("a", None, None), (None, 1, 2)]
    s = spark.createDataFrame([*spans, spans[0], ("a", None, 4, 1), ("a", 9, 8, 1)], "k string, start long, end long, no int")
    p = spark.createDataFrame(places, "k string, start long, end long")
    got = sorted((r.k, r.start, r.end, r.no) for r in occurrences.within(p, s, "k", "no").collect())
    held = [(k, a, b, no) for k, a, b in places if None not in (k, a) for k2, c, d, no in [*spans, spans[0]] if k == k2 and c <= a and b <= d]
    assert got == sorted(held) and len(got) > 5000
    assert occurrences.within(p, s.limit(0), "k", "no").count() == occurrences.within(p.limit(0), s, "k", "no").count() == 0


def test_spans_of_one_text():
    rnd = random.Random(6)
    spans = [(s := rnd.randrange(200), s + rnd.randrange(40)) for _ in range(30)]
    held = occurrences.Spans(spans)
    assert all(held.hold(a, b) == any(c <= a and b <= d for c, d in spans) for a in range(-1, 240) for b in range(a, a + 45)) and not occurrences.Spans([]).hold(0, 0)
