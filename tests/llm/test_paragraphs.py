"""Paragraph dedup against all pairs."""

import random
from itertools import combinations

import numpy as np

from anchorage.llm import paragraphs as P
from anchorage.llm import words as W
from anchorage.llm.store import Scratch


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(25, 70))] for _ in range(8)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base)) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(3, 60))]
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines), "s"))
    return rows


def own_lines(text, least=20):
    """(index of the first word, words) of each line of `least` words or more, by str.split alone."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        words = line.lower().split()
        if len(words) >= least:
            out.append((at, words))
        at += len(words)
    return out


def brute(rows, least=0.8):
    """{(doc, first word): the component's least such key}, by plain sets of word tuples."""
    pars = []
    for i, t, _ in rows:
        for s, w in own_lines(t):
            pars.append(((i, s), {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    label = {k: k for k, _ in pars}
    near = [(a, b) for (a, x), (b, y) in combinations(pars, 2) if len(x & y) >= least * len(x | y)]
    moved = True
    while moved:
        moved = False
        for a, b in near:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_against_all_pairs(spark, docs, monkeypatch):
    # Windows longer than any run of these words, so that only paragraphs count.
    monkeypatch.setattr(P, "repeated_passages", lambda scratch, named, anchored, pars: pars.selectExpr("doc_id", "th", "filter(pars, p -> false) as passages"))
    rows = corpus(3)
    label = brute(rows)
    got = {r.doc_id: r for r in P.dedup_paragraphs(docs(rows)).collect()}
    for i, t, _ in rows:
        size = {s: len(w) for s, w in own_lines(t)}
        gone = {k for (d, s), c in label.items() if d == i and c != (d, s) for k in range(s, s + size[s])}
        assert got[i].kept.split() == [w for k, w in enumerate(t.split()) if k not in gone]
        several = {c[0] for (d, s), c in label.items() if d == i and sum(x == c for x in label.values()) > 1}
        assert got[i].class_ids == sorted(several)
        assert (got[i].n_linked > 0) == bool(several) and (got[i].n_removed > 0) == bool(gone)


def test_odd_rows(docs):
    long_line = " ".join("word%d" % (i * i % 977) for i in range(600))
    par = " ".join("p%d" % i for i in range(30))
    rows = [(1, None, "a"), (2, "", "a"), (3, par, "a"), (4, "x\n" + par.upper() + "\ny", "a"), (4, "x\n" + par.upper() + "\ny", "a"), (None, par, "a"), (5, "lead in words " + long_line, "b"), (6, "others here " + long_line + " tail", "b"), (7, "short line\n" * 50, "c")]
    got = P.dedup_paragraphs(docs(rows)).collect()
    assert len(got) == len(rows) and P.dedup_paragraphs(docs([])).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[4].kept == "x\ny" and by[3].n_removed == 0 and by[3].n_linked == 1 and by[7].n_linked == 0 and by[None].n_removed == 0 and by[7].kept == rows[8][1]
    assert by[4].class_ids == [3] and by[1].kept == "" == by[2].kept
    assert by[6].n_chars_removed > 0.6 * len(long_line) and by[5].n_removed == 0


def test_scan_is_split(monkeypatch):
    texts = [None, "", "One two\n\n three", " \u2003x\u00a0y\tz ", "\u0130stanbul STRASSE \u03a3\u03c3", "a " * 4000, "w" * 3000 + " tail\nend"]
    hashes = {}
    for chunk in (1 << 20, 50):
        monkeypatch.setattr(W, "CHUNK", chunk)
        w = W.scan(texts)
        for i, t in enumerate(texts):
            a, z = w.first[i], w.first[i + 1]
            assert [t[s:e] for s, e in zip(w.start[a:z], w.end[a:z])] == (t or "").split()
            assert [int(x) for x in w.line[a:z]] == [n for n, x in enumerate((t or "").split("\n")) for _ in x.split()]
            for s, e, h in zip(w.start[a:z], w.end[a:z], w.h[a:z]):
                assert hashes.setdefault(int(h), t[s:e].lower()) == t[s:e].lower()
    assert len(hashes) == len(set(hashes.values()))


def shards(spark, rows):
    every = P.read(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), 20)
    scratch = Scratch(spark)
    every = scratch.put(every)
    comp = P.components(scratch, every.join(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), "doc_id").select("doc_id", "text"), every.selectExpr("doc_id", "th", "inline(pars)"))
    node = {bytes(r.node): r.component for r in comp.collect()}
    return [node.get(bytes(r.pars[0].par)) for r in every.orderBy("doc_id").collect()]


def test_large_bucket_of_near_copies(spark):
    rng = random.Random(9)
    words = ["v%d" % i for i in range(60)]
    rows = []
    for i in range(400):
        w = list(words)
        w[rng.randrange(60)] = "e%d" % i
        rows.append((i, " ".join(w), "s"))
    assert len(set(shards(spark, rows))) == 1 and shards(spark, rows)[0] is not None


def test_crowded_buckets_are_dealt(spark, monkeypatch):
    """Buckets beyond CROWD link the same paragraphs as small ones, those outside the centre's ball included."""
    rng = random.Random(4)
    words = ["v%d" % i for i in range(100)]
    rows = []
    for i in range(120):
        w = list(words)
        for _ in range(rng.choice([1, 2, 9, 10, 14])):
            w[rng.randrange(100)] = "e%d" % rng.randrange(10**6)
        rows.append((i, " ".join(w), "s"))
    whole = shards(spark, rows)
    monkeypatch.setattr(P, "CROWD", 7)
    dealt = shards(spark, rows)
    same = lambda c: [[x is not None and x == y for y in c] for x in c]
    assert same(whole) == same(dealt) and None in whole


def test_bands_find_similar():
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(200):
        s = rng.integers(0, 1 << 63, 120).astype(np.uint64)
        t = s.copy()
        t[40:47] = rng.integers(0, 1 << 63, 7).astype(np.uint64)  # 11 of 116 shingles differ on both sides
        hits += bool(set(P.bands(s, np.array([0]), np.array([120]))[0].tolist()) & set(P.bands(t, np.array([0]), np.array([120]))[0].tolist()))
    assert hits >= 198


def test_passages_in_running_text(docs):
    rng = random.Random(5)
    other = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], []
    for k, (size, line) in enumerate([(z, n) for z in (50, 51, 60, 80, 100) for n in (150, 400)] * 2):
        shared = other(size)
        for j in range(2):
            cut = rng.randint(1, line - size - 1)
            rows.append((2 * k + j, " ".join([*other(cut), *(w.upper() if j else w for w in shared), *other(line - size - cut)]), "s"))
        pairs.append((size, rows[-1][1], " ".join(shared).upper()))
    got = {r.doc_id: r for r in P.dedup_paragraphs(docs(rows)).collect()}
    for k, (size, text, shared) in enumerate(pairs):
        first, second = got[2 * k], got[2 * k + 1]
        assert first.n_removed == 0 and first.kept == rows[2 * k][1]
        if size == 50:
            assert second.n_removed == second.n_linked == 0 and second.class_ids == []
        else:
            assert first.class_ids == second.class_ids == [2 * k] and second.n_removed == first.n_linked == second.n_linked == 1
            assert second.kept == text.replace(" " + shared, "")


def test_passages_against_all_windows(docs):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(300)]
    base = [rng.choice(pool) for _ in range(400)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 3)):
            a, cut = rng.randrange(300), rng.randint(5, 40)
            own = [rng.choice(pool) for _ in range(60)]
            lines.append(" ".join([*own[:cut], *base[a : a + rng.randint(30, 95)], *own[cut:]]))
        rows.append((i, "\n".join(lines), "s"))
    stand, kept = {}, {}
    for i, t, _ in rows:
        words = t.split()
        for s in range(len(words) - 50):
            stand.setdefault(tuple(words[s : s + 51]), []).append((i, s))
    gone, classes = {i: set() for i, *_ in rows}, {i: set() for i, *_ in rows}
    for at in stand.values():
        for i, s in at:
            if len({j for j, _ in at}) > 1:
                classes[i].add(at[0][0])
                if i != at[0][0]:
                    gone[i] |= set(range(s, s + 51))
    assert sum(map(bool, gone.values())) > 10
    for r in P.dedup_paragraphs(docs(rows)).collect():
        words = rows[r.doc_id][1].split()
        assert r.kept.split() == [w for k, w in enumerate(words) if k not in gone[r.doc_id]]
        # A window of a run that is settled as a whole has the class of the run.
        assert bool(r.class_ids) == bool(classes[r.doc_id]) == (r.n_linked > 0) and set(r.class_ids) <= {i for i, *_ in rows}
        assert set(classes[r.doc_id]) & set(r.class_ids) or not classes[r.doc_id]


def test_planted_passages_in_lines_that_differ(docs):
    """Passages of 51 to 160 words in lines of 120 to 400 words, over line ends too, some with an edit: 0.9 of the documents at least are linked, and none without a passage."""
    rng = random.Random(12)
    other = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, planted = [], set()
    for k in range(60):
        shared = other(rng.randint(51, 160))
        for j in range(2):
            mine, line = list(shared), rng.choice([120, 160, 200, 400])
            if k % 4 == 3 and j:
                mine[rng.randrange(len(mine))] = "edited"
            cut = rng.randint(1, max(line - len(mine), 2))
            words = [*other(cut), *mine, *other(max(line - len(mine) - cut, 1))]
            if k % 3 == 2:
                words[rng.randrange(len(words))] += "\n"
            planted.add(2 * k + j)
            rows.append((2 * k + j, " ".join(words), "s"))
    rows += [(1000 + i, " ".join(other(200)), "s") for i in range(60)]
    got = {r.doc_id: r for r in P.dedup_paragraphs(docs(rows)).collect()}
    caught = [i for i in planted if got[i].n_linked]
    assert len(caught) >= 0.9 * len(planted) and not any(got[1000 + i].n_linked for i in range(60))
    exact = [i for i in planted if i // 2 % 4 != 3]
    assert all(got[i].n_linked == 1 and (got[i].n_removed == 1) == (i % 2 == 1) for i in exact)
