"""Substring deduplication by paragraphs: MinHash bands, verified Jaccard similarity, components of removals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .groups import Forest, whole_runs
from .passages import GRAM, PASSAGE, repeated_passages
from .store import Scratch
from .suffix import _identified, _with_text
from .words import BASES, MIX, Words, rolled, run_hashes, scan, slices

#: Words of a shingle.
SHINGLE = 5
#: Bands of rows: a pair at similarity 0.8 collides in one at least with probability 1 - (1 - 0.8^3)^10 = 0.9992.
BANDS, ROWS = 10, 3
#: Distinct paragraphs in a band's bucket from which on the bucket is dealt over several tasks.
CROWD = 1000
_rng = np.random.Generator(np.random.PCG64(7))
MULT = _rng.integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
ADD = _rng.integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def lines_of(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) in word numbers of the lines with `least` words or more."""
    if not len(words.h):
        return (np.zeros(0, dtype=np.int64),) * 2
    fresh = np.zeros(len(words.h), dtype=bool)
    fresh[words.first[:-1][words.first[:-1] < len(words.h)]] = True
    fresh[1:] |= np.diff(words.line) != 0
    lo = np.flatnonzero(fresh)
    hi = np.append(lo[1:], len(words.h))
    return lo[hi - lo >= least], hi[hi - lo >= least]


def bands(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """One row for each run h[lo:hi] of SHINGLE words or more: hashes of each band's number and the MinHashes of its rows."""
    s = np.append(rolled(h, SHINGLE), np.uint64(0))
    at = np.stack([lo, hi - SHINGLE + 1], axis=1).ravel()
    out = np.empty((len(lo), BANDS), dtype=np.uint64)
    for b in range(BANDS if len(lo) else 0):
        key = np.full(len(lo), b + 1, dtype=np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            key = (key ^ np.minimum.reduceat(s * MULT[j] + ADD[j], at)[::2]) * MIX
            key ^= key >> np.uint64(31)
        out[:, b] = key
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Exact Jaccard similarity of two sorted sets against a bound."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _nested(owner_first: np.ndarray, **columns) -> pa.Array:
    """A list of structs for each text, from flat columns."""
    flat = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(owner_first.astype(np.int32)), flat)


def _anchors(w: Words) -> tuple[np.ndarray, ...]:
    """(lo, hi, gram, run) of each run of neighbouring windows of PASSAGE words that have the same anchor: words from lo to hi, the anchor's hash, the run's hash.

    The anchor of a window is the gram of least hash in it, the first of several, which the window's own words decide.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(w.h) < PASSAGE:
        return none, none, none, none
    g = rolled(w.h, GRAM)
    windows = sliding_window_view(g, PASSAGE - GRAM + 1)
    # In blocks, as argmin copies what it is given.
    anchor = np.concatenate([windows[i : i + 8192].argmin(axis=1) + np.arange(i, min(i + 8192, len(windows))) for i in range(0, len(windows), 8192)])
    # Windows must end in the text where they begin.
    text_end = np.repeat(w.first[1:], np.diff(w.first))[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + PASSAGE <= text_end)
    if not len(at):
        return none, none, none, none
    new = np.append(True, (np.diff(anchor[at]) != 0) | (np.diff(at) != 1))
    lo = at[new]
    hi = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + PASSAGE
    return lo, hi, g[anchor[lo]].view(np.int64), run_hashes(w.h, lo, hi, BASES[1]).view(np.int64)


def read(docs: DataFrame, least_words: int, whole: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, th, pars, grams) for each row, all places in words of the text.

    pars: (w0, w1, par, bands) of each line of least_words or more, or of the whole text; par is a hash of its words, and
    what has under SHINGLE words has no bands. grams: (w0, w1, h, c), see _anchors(); none if whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("text").to_pylist()
            for a, z in slices(every):
                w = scan(every[a:z])
                lo, hi = (w.first[:-1], w.first[1:]) if whole else lines_of(w, least_words)
                several = hi - lo >= SHINGLE
                keys = bands(w.h, lo[several], hi[several]).view(np.int64).ravel()
                base = np.repeat(w.first[:-1], np.diff(w.first))  # of each word, where its text begins
                own = lo - w.first[:-1] if whole else None
                first = np.arange(z - a + 1) if whole else np.searchsorted(lo, w.first)
                raw = np.stack([run_hashes(w.h, lo, hi, b) for b in BASES], axis=1).astype("<u8").tobytes() if len(lo) else b""
                par = pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())
                band = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(several) * BANDS).astype(np.int32)), pa.array(keys))
                w0 = (own if whole else lo - base[lo]).astype(np.int32)
                pars = _nested(first, w0=w0, w1=w0 + (hi - lo).astype(np.int32), par=par, bands=band)
                glo, ghi, h, c = (np.zeros(0, dtype=np.int64),) * 4 if whole else _anchors(w)
                g0 = (glo - base[glo]).astype(np.int32)
                grams = _nested(np.searchsorted(glo, w.first), w0=g0, w1=g0 + (ghi - glo).astype(np.int32), h=h, c=c)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:z], batch.column("th")[a:z], pars, grams], names=["doc_id", "th", "pars", "grams"])

    schema = "doc_id long, th long, pars array<struct<w0:int,w1:int,par:binary,bands:array<long>>>, grams array<struct<w0:int,w1:int,h:long,c:long>>"
    return _identified(docs).drop("own").mapInArrow(run, schema)


def components(scratch: Scratch, docs: DataFrame, pars: DataFrame, least: float = 0.8) -> DataFrame:
    """pars(doc_id, th, w0, w1, par, bands) of texts in docs -> (node, component): the number of the component of each par that is linked to another.

    Equal paragraphs are one node, however many there are. Distinct ones meet where a band of their MinHashes is the same;
    only of those are shingle sets moved. In a band's bucket each paragraph is compared with the clusters found so far,
    member by member until one is similar enough, and with none of its own cluster, so a bucket of near copies takes
    time in proportion to it and gives a spanning forest; no link between different paragraphs is lost. Buckets of over
    CROWD paragraphs are dealt over tasks, see _dealt().
    """
    # A distinct paragraph's bands, and which text it is read from again. Its number holds from here on, as it is written
    # with it; numbers make the rows of the bands and of the components short.
    signed = pars.groupBy("par").agg(F.min(F.struct("doc_id", "th", "w0", "w1", "bands")).alias("f"))
    signed = scratch.put(signed.withColumn("id", F.monotonically_increasing_id()))
    keys = signed.select("id", F.explode("f.bands").alias("key"))
    sizes = scratch.put(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = scratch.put(keys.join(sizes, "key"))
    scratch.drop(sizes)
    source = signed.join(met.select("id").distinct(), "id", "left_semi").groupBy("f.doc_id", "f.th").agg(F.collect_list(F.struct("f.w0", "f.w1", "id")).alias("p")).select("doc_id", "th", "p.w0", "p.w1", "p.id")

    def reread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, lists = b["text"].tolist(), [b[c].tolist() for c in ("w0", "w1", "id")]
            for a, z in slices(texts):
                w, rows = scan(texts[a:z]), []
                for i in range(a, z):
                    first = int(w.first[i - a])
                    for lo, hi, n in zip(*[x[i].tolist() for x in lists], strict=True):
                        rows.append((n, np.unique(rolled(w.h[first + lo : first + hi], SHINGLE)).tobytes()))
                yield pd.DataFrame(rows, columns=["id", "shingles"])

    sets = scratch.put(_with_text(docs, source, "inner").mapInPandas(reread, "id long, shingles binary"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_runs(batches, ["key", "shard"]):
            ids, blobs, balls, forest = frame["id"].tolist(), frame["shingles"].tolist(), frame["ball"].tolist(), Forest()
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                own = [np.frombuffer(x, dtype=np.uint64) for x in blobs[a:z]]
                ball = [i for i in range(len(own)) if balls[a + i]]
                groups = [ball] if ball else []  # linked through its centre already
                for i in range(len(own)):
                    if balls[a + i]:
                        continue
                    joined = [g for g in groups if any(similar(own[i], own[j], least) for j in g)]
                    for g in joined:
                        forest.unite(ids[a + i], ids[a + g[0]])
                    groups = [g for g in groups if g not in joined] + [[i, *[j for g in joined for j in g]]]
            if forest.links:
                yield pd.DataFrame(forest.links, columns=["a", "b"])

    moved = met.join(sets, "id")
    shards = moved.where(F.col("n") <= CROWD).select("key", F.lit(0).cast("long").alias("shard"), "id", "shingles", F.lit(False).alias("ball"))
    stars = None
    if not met.where(F.col("n") > CROWD).isEmpty():
        stars, dealt = _dealt(scratch, moved.where(F.col("n") > CROWD), least)
        shards = shards.union(dealt)
    links = shards.repartition("key", "shard").sortWithinPartitions("key", "shard", "id").mapInPandas(verify, "a long, b long")
    links = scratch.put(links if stars is None else links.union(stars))
    scratch.drop(met)
    scratch.drop(sets)
    comp = connected_components(scratch, links)
    comp = comp.union(comp.select(F.col("component").alias("node"), "component").distinct())  # roots have no row of their own
    named = scratch.put(signed.select("id", "par").join(comp, F.col("id") == F.col("node")).select(F.col("par").alias("node"), "component"))
    scratch.drop(signed)
    return named


def _dealt(scratch: Scratch, crowd: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """crowd(key, n, id, shingles): large buckets -> (links to each bucket's centre, shards (key, shard, id, shingles, ball)).

    One member of a bucket is its centre, and all that are similar to it are its ball, linked by a star. What is left to
    compare are the members outside, with each other and with the ball: members fall in blocks of about CROWD, and each
    pair of blocks is a shard. A bucket without members outside its ball, as one of near copies is, has no shard.
    """
    crowd = scratch.put(crowd)
    centre = scratch.put(crowd.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("o"), F.col("id").alias("cid"), F.col("shingles").alias("of"))).alias("c")).select("key", "c.cid", "c.of"))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), least) for x, y in zip(a, b, strict=True)])

    judged = scratch.put(crowd.join(centre, "key").select("key", "n", "id", "cid", "shingles", near("shingles", "of").alias("ball")))
    outside = scratch.put(judged.where("not ball").select("key").distinct())
    k = F.ceil(F.col("n") / CROWD).cast("long")
    mine = F.pmod(F.xxhash64("id", "key"), k)
    others = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda y: F.least(mine, y) * k + F.greatest(mine, y))
    shards = judged.join(outside, "key", "left_semi").select("key", F.explode(others).alias("shard"), "id", "shingles", "ball")
    return judged.where("ball and id <> cid").select(F.col("cid").alias("a"), F.col("id").alias("b")), shards


def near_copies(scratch: Scratch, docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs(doc_id, text), no nulls -> distinct (doc_id, th, first): for each text the least (doc_id, th) of the texts linked to it from a Jaccard similarity of `least` on 5-word shingles, its own included."""
    every = scratch.put(read(docs, 0, whole=True))
    pars = every.select("doc_id", "th", F.inline("pars"))
    comp = components(scratch, docs, pars, least)
    named = scratch.put(_classed(pars, comp).select("doc_id", "th", "c").distinct())
    scratch.drop(every)
    kept = scratch.put(named.groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("first")))
    return named.join(kept, "c").select("doc_id", "th", "first")


def _classed(pars: DataFrame, comp: DataFrame) -> DataFrame:
    """pars with `c`, the component of each paragraph or, where it has none, its hash."""
    return pars.join(comp, F.col("par") == F.col("node"), "left").withColumn("c", F.coalesce(F.concat(F.lit("component "), F.col("component").cast("string")).cast("binary"), F.col("par")))


def _without(text: str, places: list[tuple[int, int]]) -> str:
    """text without some [start, end) ranges of whole words; a range that fills its lines takes a line feed with it, another one the white space before it."""
    parts, last = [], 0
    for start, end in places:
        a, z = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        z = len(text) if z < 0 else z
        if not text[a:start].strip() and not text[end:z].strip():
            start, end = a, z
            if start > last:
                start -= 1
            elif end < len(text):
                end += 1
        else:
            while start > last and text[start - 1] != "\n" and text[start - 1].isspace():
                start -= 1
        parts.append(text[last:start])
        last = max(end, last)
    return "".join([*parts, text[last:]])


def _runs(spans) -> list[tuple[int, int]]:
    """Maximal runs of [w0, w1) ranges that touch or overlap."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def dedup_paragraphs(docs: DataFrame, least: float = 0.8, least_words: int = 20) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_linked, n_removed, n_chars_removed, class_ids, kept_sha256, kept), one row for each row of docs.

    A paragraph is a line of least_words or more (shorter ones are for line dedup). Paragraphs are linked from a Jaccard
    similarity of `least` on 5-word shingles of their lower-cased words; of each component the first paragraph by doc_id,
    then place, stays, all others are removed. Linked too are passages: windows of passages.PASSAGE words that stand
    under several doc_ids, wherever lines end; the smallest doc_id keeps them (see repeated_passages()).
    n_linked: the maximal runs of words of the text that are in a linked paragraph or passage, whether kept here or not, so
    0 for a text that shares none. n_removed: the maximal runs that are removed. class_ids: for each such component and
    passage the doc_id that keeps it; sorted, each once. Null and empty texts have none.
    Rows with a null doc_id lose nothing and count for none. Rows are told apart by doc_id and text, so repeated rows are
    one document and come back each. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    named_docs = docs.where("doc_id is not null")
    every = scratch.put(read(named_docs, least_words))
    pars = every.select("doc_id", "th", F.inline("pars"))
    comp = components(scratch, named_docs, pars, least)
    named = scratch.put(_classed(pars, comp).select("doc_id", "th", "w0", "w1", "c").distinct())
    place = F.struct("doc_id", "w0", "th")
    kept = scratch.put(named.groupBy("c").agg(F.min(place).alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    cut = named.join(kept, "c").select("doc_id", "th", F.struct("w0", "w1", (place != F.col("keep")).alias("gone"), F.col("keep.doc_id").alias("class")).alias("p"))
    lists = scratch.put(cut.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("p")).alias("pars")))
    scratch.drop(named)
    passages = repeated_passages(scratch, named_docs, every.select("doc_id", "th", "grams"), lists)
    scratch.drop(every)
    none = F.array().cast("array<struct<w0:int,w1:int,gone:boolean,class:bigint>>")
    lists = lists.join(passages, ["doc_id", "th"], "full").select("doc_id", "th", F.concat(F.coalesce("pars", none), F.coalesce("passages", none)).alias("p"))
    lists = lists.select("doc_id", "th", "p.w0", "p.w1", "p.gone", "p.class")

    @F.pandas_udf("n_linked long, n_removed long, n_chars_removed long, class_ids array<long>, kept_sha256 string, kept string")
    def rest(texts: pd.Series, w0: pd.Series, w1: pd.Series, gone: pd.Series, classes: pd.Series) -> pd.DataFrame:
        rows, every = [], texts.tolist()
        empty = np.zeros(0, dtype=np.int64)
        w0, w1, gone, classes = ([empty if x is None else np.asarray(x) for x in c] for c in (w0, w1, gone, classes))
        for a, z in slices(every):
            cut = [_runs(zip(w0[i][gone[i].astype(bool)].tolist(), w1[i][gone[i].astype(bool)].tolist(), strict=True)) for i in range(a, z)]
            w = scan([t if c else None for t, c in zip(every[a:z], cut, strict=True)])
            for i in range(a, z):
                text, runs, first = every[i] or "", cut[i - a], int(w.first[i - a])
                kept = _without(text, [(int(w.start[first + lo]), int(w.end[first + hi - 1])) for lo, hi in runs]) if runs else text
                linked = _runs(zip(w0[i].tolist(), w1[i].tolist(), strict=True))
                rows.append((len(linked), len(runs), len(text) - len(kept), np.unique(classes[i]).tolist(), hashlib.sha256(kept.encode("utf-8", "replace")).hexdigest(), kept))
        return pd.DataFrame(rows, columns=["n_linked", "n_removed", "n_chars_removed", "class_ids", "kept_sha256", "kept"])

    return _with_text(docs, lists, "left").select(F.col("own").alias("doc_id"), rest("text", "w0", "w1", "gone", "class").alias("r")).select("doc_id", "r.*")
