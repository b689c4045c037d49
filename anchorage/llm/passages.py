"""Verbatim passages that running text shares across documents: windows of words that meet on their anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .suffix import _with_text
from .words import BASES, run_hashes, scan, slices

#: Words of a window that counts, and of the grams among which a window's anchor is the one of least hash.
PASSAGE, GRAM = 51, 12


def repeated_passages(scratch: Scratch, docs: DataFrame, anchored: DataFrame, pars: DataFrame) -> DataFrame:
    """anchored(doc_id, th, grams: array of (w0, w1, h, c)), pars(doc_id, th, pars: array of (w0, w1, gone, ...)) -> (doc_id, th, passages: sorted array of (w0, w1, gone, class)).

    Each window of PASSAGE words, lower-cased and whatever white space parts them, that also stands under another doc_id
    counts, unless all its words are in paragraphs that are gone. The smallest doc_id keeps it and is its class, in all
    others it is gone. Repeats within one document are left alone.

    1. Neighbouring windows with the same anchor are one run, known by the anchor's hash h and a hash c of all the run's
       words. Equal windows have equal anchors, so runs whose anchor only one document has go first.
    2. Of the others, runs that are equal as a whole are settled without a look at single windows.
    3. The windows of open runs are compared one by one, with those of one run of each settled class that has the same
       anchor: its first, which stands as long as no smaller doc_id has its windows.
    Comparisons are of two 64-bit hashes.
    """
    gone = pars.select("doc_id", "th", F.filter("pars", lambda p: p["gone"]).alias("cut")).where(F.size("cut") > 0)
    left = anchored.where(F.size("grams") > 0).join(gone, ["doc_id", "th"], "left")

    def stands(g):
        """Whether some word of the run is in no paragraph that is gone."""
        inside = lambda n, p: n + F.greatest(F.least(p["w1"], g["w1"]) - F.greatest(p["w0"], g["w0"]), F.lit(0))
        return F.aggregate("cut", F.lit(0), inside) < g["w1"] - g["w0"]

    runs = F.when(F.col("cut").isNull(), F.col("grams")).otherwise(F.filter("grams", stands))
    runs = scratch.put(left.select("doc_id", "th", F.inline(runs)).distinct())
    shared = scratch.put(runs.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"))
    met = scratch.put(runs.join(shared, "h", "left_semi"))
    scratch.drop(runs)
    known = scratch.put(met.groupBy("h", "c").agg(F.min("doc_id").alias("class"), F.max("doc_id").alias("last")).where("class < last").drop("last"))
    met = scratch.put(met.join(known, ["h", "c"], "left"))
    open_runs = met.where("class is null")
    anchors = scratch.put(open_runs.select("h").distinct())
    firsts = met.where("class = doc_id").join(anchors, "h", "left_semi")
    todo = open_runs.union(firsts.select(open_runs.columns)).groupBy("doc_id", "th").agg(F.collect_set(F.struct("w0", "w1", "h")).alias("r")).select("doc_id", "th", "r.w0", "r.w1", "r.h")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, lists = b["text"].tolist(), [b[c].tolist() for c in ("w0", "w1", "h")]
            for a, z in slices(texts):
                w = scan(texts[a:z])
                some = np.stack([np.concatenate(x[a:z]).astype(np.int64) for x in lists], axis=1)
                owner = np.repeat(np.arange(a, z), [len(x) for x in lists[0][a:z]])
                n = some[:, 1] - some[:, 0] - PASSAGE + 1
                # Each run's windows, one after another.
                at = np.repeat(some[:, 0] - np.cumsum(n) + n, n) + np.arange(n.sum())
                owner = np.repeat(owner, n)
                lo = at + w.first[owner - a]
                keys = run_hashes(w.h, lo, lo + PASSAGE, BASES[1]).view(np.int64)
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[owner], "th": b["th"].to_numpy()[owner], "w0": at.astype(np.int32), "h": np.repeat(some[:, 2], n), "c": keys})

    each = scratch.put(_with_text(docs, todo, "inner").mapInPandas(windows, "doc_id long, th long, w0 int, h long, c long"))
    twice = scratch.put(each.groupBy("h", "c").agg(F.min("doc_id").alias("class"), F.max("doc_id").alias("last")).where("class < last").drop("last"))
    passage = lambda df: df.select("doc_id", "th", F.struct("w0", "w1", (F.col("doc_id") != F.col("class")).alias("gone"), "class").alias("w"))
    found = passage(met.where("class is not null")).union(passage(each.join(twice, ["h", "c"]).withColumn("w1", F.col("w0") + PASSAGE)))
    out = scratch.put(found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("w")).alias("passages")))
    for used in (met, known, anchors, each, twice):
        scratch.drop(used)
    return out
