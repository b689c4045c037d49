"""Penalised change points: shortest paths over the days of each series, exact to the last tie."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")
#: Series of a batch in Python, series that step together, and most days of these altogether.
BATCH, TOGETHER, CELLS = 1024, 128, 1 << 20


def daily_series(rows: DataFrame, key: str, day: str, amount: str) -> DataFrame:
    """rows -> (key, days array<struct<day long, total long>>) by ascending day, of rows whose day and amount are not null.

    Rows are summed by key and day before they are shuffled, so that a key with a third of all rows sends a row for each
    day and task; the list of a key is bounded by its days.
    """
    some = rows.select(F.col(key), F.unix_date(F.col(day).cast("date")).cast("long").alias("day"), F.col(amount).cast("long").alias("amount"))
    daily = some.where(F.col("day").isNotNull() & F.col("amount").isNotNull()).groupBy(key, "day").agg(F.sum("amount").alias("total"))
    return daily.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("day", "total"))).alias("days"))


def _logs(spread: np.ndarray) -> np.ndarray:
    """floor(1000 ln V); where a product is so near a whole number that the last bit decides, by the C library's log."""
    x = 1000.0 * (np.log(spread) if spread.dtype != object else np.array([math.log(v) for v in spread.flat]).reshape(spread.shape))
    out, low = (x + 1e-7).astype(np.int64), (x - 1e-7).astype(np.int64)
    if (out != low).any():
        for i in np.flatnonzero(out != low):
            out.flat[i] = math.floor(1000.0 * math.log(int(spread.flat[i])))
    return out


class Series:
    """The daily totals of one series without gaps, with running sums of them and of their squares."""

    def __init__(self, days: np.ndarray, totals: np.ndarray):
        self.first, self.n = int(days[0]), int(days[-1] - days[0]) + 1
        # Whole numbers are exact in 64 bits only so far; beyond that Python's own are.
        largest = max(abs(int(totals.max())), abs(int(totals.min())))
        self.small = self.n * self.n * largest * largest < 1 << 62
        x = np.zeros(self.n + 1, dtype=np.int64 if self.small else object)
        x[1 + days - days[0]] = totals if self.small else [int(t) for t in totals]
        self.sums, self.squares = np.cumsum(x), np.cumsum(x * x)


def _spreads(length: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    wide = length if total.dtype != object else length.astype(object)
    return 1 + (wide * squares - total * total) // (wide * wide)


def shortest(series: list[Series], least: int, penalty: int) -> list[list[int]]:
    """For each series the starts of the segments of its cheapest path, and its number of days at the end.

    Nodes are the days and the end, edges the segments of at least `least` days that leave none shorter behind. Dijkstra's
    algorithm, one heap for each series: a node is settled when it is the least in the heap by cost, then segments, then
    day, and only then are the edges that leave it made. Among equal keys the earliest predecessor is kept. The series
    take their steps together, so that an array operation makes the edges of as many nodes as there are series.
    """
    ns = np.array([s.n for s in series])
    width = int(ns.max()) + 1
    kind = np.int64 if all(s.small for s in series) else object
    sums, squares = np.zeros((len(series), width), dtype=kind), np.zeros((len(series), width), dtype=kind)
    # Cost and number of segments as one whole number, which orders like the two; in the heaps the day too. Where no segment ends stands -1.
    most, unit = np.iinfo(np.int64).max, width
    key, before = np.full((len(series), width), most), np.full((len(series), width), -1)
    for i, s in enumerate(series):
        sums[i, : s.n + 1], squares[i, : s.n + 1] = s.sums, s.squares
        sums[i, s.n + 1 :], squares[i, s.n + 1 :] = s.sums[-1], s.squares[-1]
        key[i, max(0, s.n - least + 1) : s.n] = -1
        key[i, s.n + 1 :] = -1
        if s.n < 2 * least:
            before[i, s.n] = 0
    heaps, settled = [[0] for _ in series], [bytearray(s.n + 1) for s in series]
    open_ = [i for i, s in enumerate(series) if s.n >= 2 * least]
    pop, push = heapq.heappop, heapq.heappush
    while open_:
        rows, ats, starts = [], [], []
        for i in open_:
            heap, known = heaps[i], settled[i]
            at, a = divmod(pop(heap), unit)
            while known[a]:
                at, a = divmod(pop(heap), unit)
            if a < len(known) - 1:
                known[a] = 1
                rows.append(i)
                ats.append(at)
                starts.append(a)
        open_ = rows
        if not rows:
            break
        r, a = np.array(rows), np.array(starts)
        lo = min(starts) + least
        length = np.arange(lo, width) - a[:, None]
        valid = length >= least
        length = np.maximum(length, 1)
        spread = _spreads(length, sums[r, lo:] - sums[r, a][:, None], squares[r, lo:] - squares[r, a][:, None])
        cost = length * _logs(np.where(valid, spread, 1)) + np.where(a > 0, penalty, 0)[:, None]
        to = cost * unit + (np.array(ats)[:, None] + 1)
        old = key[r, lo:]
        for i, j in zip(*np.nonzero((to == old) & valid), strict=True):
            before[rows[i], lo + j] = min(before[rows[i], lo + j], starts[i])
        # A node that costs more than the end does by now is on no cheapest path; a day is followed by another penalty.
        below = key[r, ns[r]][:, None] - np.where(np.arange(lo, width) < ns[r][:, None], penalty * unit, 0)
        won, node = np.nonzero(valid & (to < np.minimum(old, below)))
        found = to[won, node]
        node += lo
        key[r[won], node], before[r[won], node] = found, a[won]
        told = found if width < 40000 else found.astype(object)
        for i, at in zip(r[won].tolist(), (told * unit + node).tolist(), strict=True):
            push(heaps[i], at)
    paths = []
    for s, came in zip(series, before, strict=True):
        path = [s.n]
        while path[-1]:
            path.append(int(came[path[-1]]))
        paths.append(path[::-1])
    return paths


def segments(series: list[Series], least: int, penalty: int) -> Iterator[list[tuple]]:
    """For each series its segments: (segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost)."""
    paths: list[list[int]] = [[]] * len(series)
    # Series of like length step together, in bounded memory; those beyond 64 bits by themselves.
    order = sorted(range(len(series)), key=lambda i: (series[i].small, series[i].n))
    at = 0
    while at < len(order):
        some = [i for i in order[at : at + TOGETHER] if series[i].small and series[i].n * TOGETHER <= CELLS] or order[at : at + 1]
        at += len(some)
        for i, path in zip(some, shortest([series[i] for i in some], least, penalty), strict=True):
            paths[i] = path
    for s, path in zip(series, paths, strict=True):
        a, z = np.array(path[:-1]), np.array(path[1:])
        total = s.sums[z] - s.sums[a]
        spread = _spreads(z - a, total, s.squares[z] - s.squares[a])
        cost = (z - a) * _logs(spread)
        best = int(cost.sum()) + penalty * (len(a) - 1)
        yield [(i + 1, s.first + int(a[i]), int(z[i] - a[i]), int(total[i]), int(spread[i]), int(cost[i]), len(a), best) for i in range(len(a))]


def change_points(series: DataFrame, key: str, least: int = 7, penalty: int = 20000) -> DataFrame:
    """series(key, days), as of daily_series() -> (key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost).

    Each series is cut into segments of at least `least` consecutive days (a shorter series is one segment) so that the
    costs' sum plus penalty per cut is least: n * floor(1000 ln V) for n days of sum S and sum of squares Q, with
    V = 1 + floor((n Q - S S) / (n n)) in whole numbers. Ties: fewest segments, then earliest starts from the last segment
    backwards. Days without rows count 0. A null key is a series of its own. A task holds one series of n days in O(n)
    memory and takes O(n n) steps for it; series are dealt over the tasks.
    """
    kind = dict(series.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                lists = batch.column("days")
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                flat = lists.flatten()
                days, totals = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("day", "total"))
                each = [Series(days[a:z], totals[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
                found = list(segments(each, least, penalty))
                owners = np.repeat(np.arange(len(found)), [len(x) for x in found])
                columns = zip(*(x for s in found for x in s), strict=True)
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 7), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owners)), *arrays], [key, *NAMES])

    return series.select(key, "days").mapInArrow(cut, f"{key} {kind}, segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long")


def sales_changes(sale_lines: DataFrame) -> DataFrame:
    """sale_lines(vendor_id, quantity, flag, shipped_at, ...) -> change_points() of each vendor's daily quantities of rows flagged kept.

    Rows with null flag, quantity or shipped_at are not taken; repeated rows are; no rows give no segments.
    """
    return change_points(daily_series(sale_lines.where(F.col("flag") == "kept"), "vendor_id", "shipped_at", "quantity"), "vendor_id")
