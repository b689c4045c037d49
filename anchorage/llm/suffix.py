"""Exact substring deduplication: a depth-limited radix sort of suffixes, most significant digits first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Bytes of the leading digit, and one in how many digits is sampled (by the digit's own hash, so alike wherever it stands).
DIGIT, SAMPLE = 32, 28
#: Starts in a run of the third pass.
STRIDE = 8
#: Bytes hashed at a time.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(42))
TABLE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for b in (BASE, INVERSE):
            p = np.full(CHUNK + DIGIT, b, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS[0], _POWERS[1]


def sampled_digits(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the sampled DIGIT-byte strings of a text, in order."""
    up, down = _powers()
    data = np.frombuffer(raw, dtype=np.uint8)
    out_p, out_h = [], []
    for at in range(0, len(data) - DIGIT + 1, CHUNK):
        part = TABLE[data[at : at + CHUNK + DIGIT - 1]]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part * up[: len(part)])])
        h = (sums[DIGIT:] - sums[:-DIGIT]) * down[: len(part) - DIGIT + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        keep = np.flatnonzero(h < np.uint64((1 << 64) // SAMPLE))
        out_p.append(keep + at)
        out_h.append(h[keep])
    if not out_p:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_p), np.concatenate(out_h).view(np.int64)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _h128(raw: bytes, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in spans]), dtype="<i8").reshape(-1, 2)


#: Stands for a null doc_id while rows pass through pandas, which would turn a column with nulls into floats; th tells it from a doc_id of that number.
NO_ID = -(1 << 63)


def row_hash(doc_id="doc_id", text="text") -> Column:
    """With doc_id, what tells rows apart: a hash of the text, and of whether there is a doc_id."""
    return F.xxhash64(text, F.isnull(doc_id))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), row_hash().alias("th"), "text", F.col("doc_id").alias("own"))


def _same(a: str, b: str):
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _with_text(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts beside what was gathered for them; the texts are dealt once and only the lists are hashed."""
    joined = _identified(docs).alias("d").join(lists.hint("shuffle_hash").alias("l"), _same("d", "l"), how)
    return joined.select("d.doc_id", "d.th", "d.text", "d.own", *[f"l.{c}" for c in lists.columns if c not in ("doc_id", "th")])


def _digits(docs: DataFrame) -> DataFrame:
    """(doc_id, th, once, more): the sampled digits that a text holds once, and more often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [np.unique(sampled_digits(_raw(t))[1], return_counts=True) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "once": [h[n == 1] for h, n in found], "more": [h[n > 1] for h, n in found]})

    return _identified(docs).drop("own").mapInPandas(run, "doc_id long, th long, once array<long>, more array<long>")


def _segments(raw: bytes, marks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, p, g): runs of starts whose windows may be repeated and have the same first sampled digit, at p, hashed to g.

    A window over a sampled digit that is found nowhere else cannot be repeated; such starts are left out. p is -1 for
    runs of windows without a sampled digit.
    """
    starts = len(raw) - window + 1
    if starts <= 0:
        return (np.zeros(0, dtype=np.int64),) * 4
    reach = window - DIGIT
    pos, h = sampled_digits(raw)
    end = len(raw) + window
    p, g = np.append(pos, end), np.append(h, 0)
    lone = np.append(pos[~np.isin(h, marks)], end)
    # A lone digit at u rules out the starts from u - reach to u, so of those before p only the ones to its left remain.
    free = np.minimum(lone[np.searchsorted(lone, p)] - reach, starts)
    before = np.append(-1, pos) + 1
    lo, hi = np.maximum(before, p - reach), np.minimum(free, p + 1)
    bare_hi = np.minimum(free, p - reach)
    over, none = np.flatnonzero((lo < hi) & (p < end)), np.flatnonzero(before < bare_hi)
    return (
        np.concatenate([lo[over], before[none]]), np.concatenate([hi[over], bare_hi[none]]),
        np.concatenate([p[over], np.full(len(none), -1)]), np.concatenate([g[over], np.zeros(len(none), dtype=np.int64)]),
    )


def _classes(scratch: Scratch, runs: DataFrame) -> DataFrame:
    """runs with `done`, whether there are several equal ones, and `rep`, whether it is the one of them that stands for all.

    What is known of each class is written before it is joined, so that the join can split one with very many runs.
    """
    place = F.xxhash64("doc_id", "th", "lo")
    known = scratch.put(runs.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"))
    out = runs.join(known, ["c1", "c2"], "left")
    out = scratch.put(out.withColumns({"done": F.col("first").isNotNull(), "rep": F.coalesce(F.col("first") == place, F.lit(False))}).drop("c1", "c2", "first"))
    scratch.drop(known)
    return out


def _lists(df: DataFrame, *cols: str) -> DataFrame:
    """For each text the runs, as an array for each of their columns: these pass into numpy as they are."""
    runs = df.groupBy("doc_id", "th").agg(F.collect_set(F.struct(*cols)).alias("runs"))
    return runs.select("doc_id", "th", *[F.col(f"runs.{c}").alias(c) for c in cols])


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... n[0] numbers, then those of the next."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _columns(c: np.ndarray, **cols) -> dict[str, np.ndarray]:
    return {k: np.asarray(v) for k, v in cols.items()} | {"c1": c[:, 0], "c2": c[:, 1]}


def _each(batches: Iterator[pd.DataFrame], columns: list[str], work) -> Iterator[pd.DataFrame]:
    """work(raw, arrays) -> columns, for each row; gathered into frames of bounded length. Rows that no list was found for have empty arrays."""
    keys: list[tuple[int, int, int]] = []
    parts: list[dict[str, np.ndarray]] = []
    rows = 0

    def frame() -> pd.DataFrame:
        n = [k[2] for k in keys]
        own = {"doc_id": np.repeat([k[0] for k in keys], n), "th": np.repeat([k[1] for k in keys], n)}
        return pd.DataFrame(own | {k: np.concatenate([p[k] for p in parts]) for k in parts[0]})

    for b in batches:
        for doc_id, th, text, *found in zip(b["doc_id"], b["th"], b["text"], *[b[c] for c in columns], strict=True):
            out = work(_raw(text), *[np.zeros(0, dtype=np.int64) if x is None else np.asarray(x) for x in found])
            if n := len(out["lo"]):
                keys.append((doc_id, th, n))
                parts.append(out)
                rows += n
            if rows > 100_000:
                yield frame()
                keys, parts, rows = [], [], 0
    if parts:
        yield frame()


def repeated_spans(scratch: Scratch, docs: DataFrame, window: int = 200) -> DataFrame:
    """(doc_id, th, spans): for each text that holds any, the [start, end) byte ranges covered by repeated windows.

    The suffixes that start at each byte are ordered through `window` bytes, in passes that each leave out what is settled:
    1. One leading digit of 32 bytes, at a sample of starts that the digit itself decides. A digit that stands only once
       rules out all starts whose window covers it.
    2. Runs of neighbouring starts that survive and whose windows share their first sampled digit: some 28 suffixes go
       through all bytes their windows cover as one row. Equal runs are repeated windows throughout. (Runs of windows
       without a sampled digit, mostly in texts that repeat a few bytes over and over, go straight to pass 4.)
    3. The remaining runs, cut into runs of 8 starts by distance from that digit, in the same way.
    4. The remaining starts one by one through all `window` bytes; equal groups are the repeated windows.
    Of each class of equal runs one goes on to the next pass where an open run has the same first digit (and distance),
    as an equal window has to have: so each window meets an equal one if there is any. Runs are compared as 128-bit hashes.
    """
    digits = scratch.put(_digits(docs))
    counted = digits.select(F.explode("once").alias("h"), F.lit(1).alias("n")).union(digits.select(F.explode("more").alias("h"), F.lit(2).alias("n")))
    twice = scratch.put(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    each = digits.select("doc_id", "th", F.explode(F.concat("once", "more")).alias("h"))
    marks = scratch.put(each.join(twice, "h", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("h").alias("marks")))
    for used in (digits, twice):
        scratch.drop(used)

    def by_digit(raw, found):
        lo, hi, p, g = _segments(raw, found.astype(np.int64), window)
        return _columns(_h128(raw, zip(lo.tolist(), (hi - 1 + window).tolist(), strict=True)), lo=lo, hi=hi, p=p, g=g)

    def by_distance(raw, lo, hi, p, g, rep):
        far, near = (p - lo) // STRIDE, (p - hi + 1) // STRIDE
        n = far - near + 1
        j, of = _spread(near, n), np.repeat(np.arange(len(lo)), n)
        a, z = np.maximum(lo[of], p[of] - j * STRIDE - STRIDE + 1), np.minimum(hi[of], p[of] - j * STRIDE + 1)
        c = _h128(raw, zip(a.tolist(), (z - 1 + window).tolist(), strict=True))
        return _columns(c, lo=a, hi=z, g=g[of], j=j, stood=rep[of])

    def by_start(raw, lo, hi, own):
        every = _spread(lo, hi - lo)
        starts = np.unique(every)
        is_mine = np.isin(starts, every[np.repeat(own.astype(bool), hi - lo)])
        c = _h128(raw, [(s, s + window) for s in starts.tolist()])
        order = np.lexsort((starts, c[:, 1], c[:, 0]))
        same = (c[order][1:] == c[order][:-1]).all(axis=1)
        first, several = np.ones(len(starts), dtype=bool), np.zeros(len(starts), dtype=bool)
        first[order[1:][same]] = False
        several[order[1:][same]] = several[order[:-1][same]] = True
        # Windows that repeat within the text are settled, and one of them stands for all; so a text that repeats one
        # word over and over sends a row for each letter of the word and not for each of its own.
        runs = np.flatnonzero(np.diff(starts[several]) > 1)
        lows, highs = (starts[several][np.append(0, runs + 1)], starts[several][np.append(runs, -1)] + 1) if several.any() else (starts[:0], starts[:0])
        alone, one = starts[first], is_mine[first] & ~several[first]
        return _columns(
            np.concatenate([c[first], np.zeros((len(lows), 2), dtype=np.int64)]), lo=np.append(alone, lows), hi=np.append(alone + 1, highs),
            mine=np.append(one, np.zeros(len(lows), dtype=bool)), settled=np.append(np.zeros(len(alone), dtype=bool), np.ones(len(lows), dtype=bool)),
        )

    key = "doc_id long, th long, lo int"
    segs = _with_text(docs, marks, "left").mapInPandas(lambda it: _each(it, ["marks"], by_digit), f"{key}, hi int, p int, g long, c1 long, c2 long")
    segs = scratch.put(segs)
    scratch.drop(marks)
    at = _classes(scratch, segs.where("p >= 0"))
    bare = scratch.put(segs.where("p < 0").select("doc_id", "th", "lo", "hi", F.lit(None).cast("long").alias("g"), F.lit(None).cast("int").alias("j"), F.lit(True).alias("mine")))
    scratch.drop(segs)
    runs = at.where("not done")
    gs = scratch.put(runs.select("g").distinct())
    runs = runs.union(at.where("rep").join(gs, "g", "left_semi").select(*at.columns))
    parts = _with_text(docs, _lists(runs, "lo", "hi", "p", "g", "rep"), "inner").mapInPandas(lambda it: _each(it, ["lo", "hi", "p", "g", "rep"], by_distance), f"{key}, hi int, g long, j int, stood boolean, c1 long, c2 long")
    parts = scratch.put(parts)
    sub = _classes(scratch, parts)
    for used in (parts, gs):
        scratch.drop(used)
    alone = sub.where("not done and not stood").select("doc_id", "th", "lo", "hi", "g", "j", F.lit(True).alias("mine"))
    gj = scratch.put(alone.select("g", "j").distinct())
    met = sub.where("rep or (stood and not done)").join(gj, ["g", "j"], "left_semi").select("doc_id", "th", "lo", "hi", "g", "j", F.lit(False).alias("mine"))
    todo = _lists(alone.union(met).union(bare), "lo", "hi", "mine")
    single = scratch.put(_with_text(docs, todo, "inner").mapInPandas(lambda it: _each(it, ["lo", "hi", "mine"], by_start), f"{key}, hi int, mine boolean, settled boolean, c1 long, c2 long"))
    scratch.drop(gj)
    again = scratch.put(single.where("not settled").groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2"))
    span = lambda df, end: df.select("doc_id", "th", F.col("lo").alias("start"), (end - 1 + window).alias("end"))
    found = span(single.where("mine").join(again, ["c1", "c2"], "left_semi"), F.col("hi"))
    found = found.union(span(single.where("settled"), F.col("hi"))).union(span(at.where("done"), F.col("hi"))).union(span(sub.where("done"), F.col("hi")))
    out = scratch.put(found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")))
    for used in (single, again, at, sub, bare):
        scratch.drop(used)
    return out


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of sorted [start, end) ranges that touch or overlap."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame, window: int = 200) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans), one row for each row of docs.

    Removes each byte covered by a string of `window` bytes that also starts anywhere else, in this text or another;
    spans are the maximal removed runs and kept the remaining bytes, which can end within a UTF-8 character. Null is the
    empty text. Texts shorter than the window lose nothing. Repeated rows are documents each, and so repeat each other;
    rows are told apart by doc_id and text, so both get the same answer. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    found = repeated_spans(scratch, docs, window)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,end:int>>")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, spans in zip(texts, found, strict=True):
            raw, cuts = _raw(text), merged([] if spans is None else spans)
            edges = [0, *[x for c in cuts for x in c], len(raw)]
            kept = b"".join([raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)])
            rows.append((len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": z} for a, z in cuts]))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return _with_text(docs, found, "left").select(F.col("own").alias("doc_id"), cut("text", "spans").alias("r")).select("doc_id", "r.*")
