"""Words of many texts at once: where they stand, and hashes of them and of runs of them, as whole arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

#: Code points worked on at a time; longer texts are cut at white space.
CHUNK = 1 << 20
#: Code points of texts that go together.
SLICE = 1 << 20
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Odd numbers, so that they have inverses modulo 2^64: a run's hash is a difference of prefix sums, moved back to power 0.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = re.compile(r"\s")
_BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    """first: of each text the index of its first word, and one more; start, end: code points in the own text; line: line feeds before the word; h: of the lower-cased word."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray
    h: np.ndarray


def _up_down(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, CHUNK)
        table = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            table.append(np.cumprod(p))
        _powers[base] = (table[0], table[1])
    return _powers[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def run_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A hash of each run h[lo:hi], the same wherever the run stands."""
    up, down = _up_down(len(h), base)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mixed((sums[hi] - sums[lo]) * down[lo])


def rolled(h: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of each run of `width` words."""
    lo = np.arange(max(len(h) - width + 1, 0))
    return run_hashes(h, lo, lo + width, base)


def _lower(s: str) -> str:
    """Lower-cased, letter for letter."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(x if len(x := c.lower()) == 1 else c for c in s)


def scan(texts: Sequence[str | None]) -> Words:
    """The words of all texts, end to end; white space is what str.isspace() says. Null and empty texts have none."""
    pieces: list[tuple[int, int, int, str]] = []
    for i, t in enumerate(texts):
        at, lines = 0, 0
        while t and at < len(t):
            to = len(t)
            if to - at > CHUNK and (m := _SPACE.search(t, at + CHUNK)):
                to = m.start()
            pieces.append((i, at, lines, t[at:to]))
            lines += t.count("\n", at, to)
            at = to
    out: list[tuple[np.ndarray, ...]] = []
    k = 0
    while k < len(pieces):
        size, z = len(pieces[k][3]), k + 1
        while z < len(pieces) and size + len(pieces[z][3]) <= CHUNK:
            size += len(pieces[z][3]) + 1
            z += 1
        out.append(_group(pieces[k:z]))
        k = z
    if not out:
        return Words(np.zeros(len(texts) + 1, dtype=np.int64), *[np.zeros(0, dtype=np.int64)] * 3, np.zeros(0, dtype=np.uint64))
    owner, start, end, line, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return Words(np.searchsorted(owner, np.arange(len(texts) + 1)), start, end, line, h)


def _group(pieces: list[tuple[int, int, int, str]]) -> tuple[np.ndarray, ...]:
    """(owner, start, end, line, h) of the words of some pieces (owner, offset, lines before, text)."""
    s = np.frombuffer(_lower("\n".join([p[3] for p in pieces])).encode("utf-32-le", "replace"), dtype=np.uint32)
    blank = _BLANK[np.minimum(s, len(_BLANK) - 1)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    base = np.cumsum([0, *[len(p[3]) + 1 for p in pieces[:-1]]])
    own = np.searchsorted(base, lo, "right") - 1
    feeds = np.concatenate([[0], np.cumsum(s == 10)])
    owner, offset, before = (np.array([p[i] for p in pieces], dtype=np.int64) for i in range(3))
    moved = (offset - base)[own]
    h = run_hashes(mixed((s.astype(np.uint64) + np.uint64(1)) * MIX), lo, hi)
    return owner[own], lo + moved, hi + moved, (feeds[lo] - feeds[base[own]]) + before[own], h


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of about SLICE code points; a longer text is one by itself."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > SLICE:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)
