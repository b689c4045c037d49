"""Runs of equal keys in a sorted stream of pandas batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd


def whole_runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches that end where a run of equal keys ends, each with the starts of its runs and its length at the end.

    The stream is sorted by the keys, so a run can cross batches; its rows are carried over.
    """
    carried: list[pd.DataFrame] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch[k].to_numpy() for k in keys]
        changed = np.zeros(len(batch) - 1, dtype=bool)
        for c in cols:
            changed |= c[1:] != c[:-1]
        cuts = np.flatnonzero(changed) + 1
        first, final = tuple(c[0] for c in cols), tuple(c[-1] for c in cols)
        if carried and first != last:
            yield _with_starts(pd.concat(carried, ignore_index=True), keys)
            carried = []
        if len(cuts):
            yield _with_starts(pd.concat([*carried, batch.iloc[: cuts[-1]]], ignore_index=True), keys)
            carried = [batch.iloc[cuts[-1] :]]
        else:
            carried.append(batch)
        last = final
    if carried:
        yield _with_starts(pd.concat(carried, ignore_index=True), keys)


def _with_starts(frame: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    changed = np.zeros(max(len(frame) - 1, 0), dtype=bool)
    for k in keys:
        c = frame[k].to_numpy()
        changed |= c[1:] != c[:-1]
    return frame, np.concatenate([[0], np.flatnonzero(changed) + 1, [len(frame)]])


class Forest:
    """Union-find; keeps one link for each union, so that links never outnumber members."""

    def __init__(self) -> None:
        self.parent: dict = {}
        self.links: list[tuple] = []

    def root(self, x):
        path = []
        while (p := self.parent.get(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            self.parent[y] = x
        return x

    def unite(self, a, b) -> bool:
        ra, rb = self.root(a), self.root(b)
        if ra == rb:
            return False
        self.parent[max(ra, rb)] = min(ra, rb)
        self.links.append((a, b))
        return True
