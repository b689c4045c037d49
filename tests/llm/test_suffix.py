"""Substring dedup against a table of all windows."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from anchorage.llm import suffix


def brute(rows, window):
    raws = [(t or "").encode() for _, t, _ in rows]
    seen = defaultdict(int)
    for r in raws:
        for i in range(len(r) - window + 1):
            seen[r[i : i + window]] += 1
    out = Counter()
    for (i, _, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for k in range(len(r) - window + 1):
            if seen[r[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def pieces(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(20, 120)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice([*shared, text(rng.randint(1, 60)), text(40)]) for _ in range(rng.randint(1, 6))]
        rows.append((i, " ".join(parts), "s"))
    near = rows[0][1] + rows[1][1]
    for i in range(8):
        k = rng.randrange(len(near))
        rows.append((100 + i, near[:k] + "!" + near[k + 1 :], "s"))
    return [*rows, rows[3], (3, rows[4][1], "s"), (None, rows[5][1], "t"), (None, "zz" + rows[5][1][10:], "t"), (60, "a" * 700, "s"), (61, "ab" * 150, "s"), (66, "xyz" * 200, "s"), (67, "q" + "xyz" * 100 + "r", "s"), (62, None, "s"), (63, "", "s"), (64, shared[0][:199], "s"), (65, shared[1][:200], "s")]


@pytest.mark.parametrize("seed", range(3))
def test_substrings(docs, seed):
    rows = pieces(seed)
    got = suffix.dedup_substrings(docs(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == brute(rows, 200)


def test_empty(docs):
    assert suffix.dedup_substrings(docs([])).count() == 0


def test_runs_cover_each_start_once():
    rng = random.Random(5)
    raw = bytes(rng.choice(b"abcdef ") for _ in range(3000))
    pos, h = suffix.sampled_digits(raw)
    marks = [x for x in sorted(set(h.tolist())) if rng.random() < 0.9]
    lo, hi, p, _ = suffix._segments(raw, suffix.np.array(marks), 200)
    starts = sorted(s for a, b in zip(lo, hi, strict=True) for s in range(a, b))
    assert all(b - 1 <= x <= a + 168 for a, b, x in zip(lo, hi, p, strict=True) if x >= 0)
    lone = [p for p, x in zip(pos.tolist(), h.tolist(), strict=True) if x not in marks]
    assert starts == [s for s in range(len(raw) - 199) if not any(s <= u <= s + 168 for u in lone)]


def test_digits_do_not_hang_on_place():
    raw = b"0123456789" * 400_000
    pos, h = suffix.sampled_digits(raw)
    assert len(raw) > 3 * suffix.CHUNK and len({(p % 10, x) for p, x in zip(pos.tolist(), h.tolist(), strict=True)}) == len({p % 10 for p in pos.tolist()})


def test_the_least_doc_id_is_no_null(docs):
    text = "".join(f"{i * i % 89:02d} some text " for i in range(30))
    got = suffix.dedup_substrings(docs([(-(1 << 63), text, "a"), (None, text, "a"), (None, "short", "a")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == sorted([(False, -(1 << 63), len(text)), (True, 0, len(text)), (True, 0, 0)])
