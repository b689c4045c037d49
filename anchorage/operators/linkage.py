"""Average-link clusters of mentions with vectors: a cluster is a sum of unit vectors, and no table of pairs exists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store

#: Clusters of a group up to which a task merges it by itself; clusters on a side of a cell; similarities that a task holds at a time.
TASK, SIDE, STRIP = 16384, 8192, 1 << 20
#: Means are compared to so many digits, so that equal ones tie whatever order they were added up in.
DIGITS = 9
_VECTOR = "array<double>"


def _is_entry(ids: np.ndarray) -> np.ndarray:
    return np.array([str(i).startswith("E") for i in ids], dtype=bool)


def _nearest(ids: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of ids the place in other (in the order of their ids) of the most similar cluster, the smaller id on ties, and
    the mean similarity of their members, which is the product of the means x and y of their vectors; -1 if none reaches
    the cutoff. Two entries of the knowledge base are never near."""
    near, best = np.full(len(ids), -1), np.full(len(ids), -np.inf)
    if not len(other):
        return near, best
    entry, entries = _is_entry(ids), _is_entry(other)
    itself = np.minimum(np.searchsorted(other, ids), len(other) - 1)
    itself = np.where(other[itself] == ids, itself, -1)
    rows = max(1, STRIP // len(other))
    for lo in range(0, len(ids), rows):
        s = x[lo : lo + rows] @ y.T
        np.round(s, DIGITS, out=s)
        own = itself[lo : lo + rows]
        s[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
        s[np.ix_(entry[lo : lo + rows], entries)] = -np.inf
        at = s.argmax(axis=1)
        top = s[np.arange(len(at)), at]
        near[lo : lo + rows], best[lo : lo + rows] = np.where(top >= cutoff, at, -1), top
    return near, best


def merge_in_task(ids: np.ndarray, sums: np.ndarray, n: np.ndarray, cutoff: float) -> dict[str, str]:
    """Id of each cluster after merging: in each round all pairs merge that are each other's nearest.

    Average linkage is reducible: no merge brings a cluster nearer to another than the nearer of its parts was. So mutual
    nearest neighbours merge in whatever order pairs are taken, a cluster's nearest stays so until one of the two merges,
    and one with no neighbour in reach never gets one. Only clusters whose nearest has gone are looked at again.
    """
    order = np.argsort(ids)
    ids, sums, n = ids[order], sums[order].astype(np.float64), n[order].astype(np.int64)
    into = np.arange(len(ids))
    near = np.full(len(ids), -1)
    live, asked = np.arange(len(ids)), np.arange(len(ids))
    while len(asked):
        x = sums[live] / n[live, None]
        place = np.searchsorted(live, asked)
        found, _ = _nearest(ids[asked], x[place], ids[live], x, cutoff)
        near[asked] = np.where(found >= 0, live[found], -1)
        live = live[near[live] >= 0]
        a = live[(near[near[live]] == live) & (live < near[live])]
        if not len(a):
            break
        b = near[a]
        # The first stays unless the second is of the knowledge base.
        swap = _is_entry(ids[b])
        keep, lose = np.where(swap, b, a), np.where(swap, a, b)
        sums[keep] += sums[lose]
        n[keep] += n[lose]
        into[lose] = keep
        gone = np.zeros(len(ids), dtype=bool)
        gone[lose] = True
        live = live[~gone[live]]
        moved = gone.copy()
        moved[keep] = True
        asked = live[moved[live] | moved[near[live]]]
    while (into[into] != into).any():
        into = into[into]
    return dict(zip(ids, ids[into], strict=True))


def cluster_vectors(vectors: DataFrame, group: str | None = None) -> DataFrame:
    """vectors(query_id, kb_link, embedding[, group]) -> (group, id, n, total): the clusters with the sums of their members'
    vectors, each made one long. Vectors without a group, null, of no length or not finite take no part. A batch is added up before it is shuffled."""
    x = F.col("embedding").cast(_VECTOR)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
    v = vectors.select((F.col(group) if group else F.lit(0)).cast("string").alias("group"), F.col("kb_link").alias("id"), x.alias("x"), norm.alias("norm"))
    v = v.where(F.col("group").isNotNull() & (F.col("norm") > 0) & (F.col("norm") < float("inf"))).select("group", "id", F.transform("x", lambda c: c / F.col("norm")).alias("total"), F.lit(1).cast("long").alias("n"))

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(frame["id"].to_numpy(), return_inverse=True)
        m = np.stack(frame["total"].to_numpy())
        total = np.zeros((len(keys), m.shape[1]))
        np.add.at(total, at, m)
        return pd.DataFrame({"group": frame["group"].iloc[0], "id": keys, "n": np.bincount(at, frame["n"]).astype(np.int64), "total": list(total)})

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, frame in batch.groupby("group"):
                yield added(frame)

    parts = v.mapInPandas(partly, f"group string, id string, n long, total {_VECTOR}")
    # A row for each batch that has mentions of a link.
    each = parts.groupBy("group", "id").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("total")).alias("parts"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    rest = F.slice("parts", 2, F.size("parts"))
    return each.select("group", "id", "n", F.aggregate(rest, F.get("parts", F.lit(0)), add).alias("total"))


def _cells(asked: DataFrame, clusters: DataFrame, sides: DataFrame, cutoff: float) -> DataFrame:
    """(group, id, near) of the asked clusters whose nearest is in reach. asked and clusters(group, id, n, total), sides(group, k).

    A group's clusters stand on k sides by the hash of their ids; asked ones meet each side in a cell, and each cell says of
    each asked cluster which of its own is nearest: k rows a cluster, not one for each pair.
    """
    side = lambda df: df.join(sides, "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias(c)
    a = side(asked)
    need = a.select("group", F.col("own").alias("i")).distinct()
    left = a.select("group", F.col("own").alias("i"), every("j"), "id", "n", "total", F.lit(True).alias("asked"))
    right = side(clusters).join(need, "group").select("group", "i", F.col("own").alias("j"), "id", "n", "total", F.lit(False).alias("asked"))

    def meet(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("id", ignore_index=True)
        x, own = np.stack(cell["total"].to_numpy()) / cell["n"].to_numpy()[:, None], cell["asked"].to_numpy()
        ids = cell["id"].to_numpy()
        near, best = _nearest(ids[own], x[own], ids[~own], x[~own], cutoff)
        hit = near >= 0
        return pd.DataFrame({"group": cell["group"].iloc[0], "id": ids[own][hit], "near": ids[~own][near[hit]], "s": best[hit]}, columns=["group", "id", "near", "s"])

    found = left.union(right).groupBy("group", "i", "j").applyInPandas(meet, "group string, id string, near string, s double")
    return found.groupBy("group", "id").agg(F.min_by("near", F.struct((-F.col("s")).alias("s"), "near")).alias("near"))


def _in_tasks(clusters: DataFrame, cutoff: float) -> DataFrame:
    """clusters(group, id, n, total) -> (group, old, new): each group by merge_in_task()."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out = merge_in_task(frame["id"].to_numpy(), np.stack(frame["total"].to_numpy()), frame["n"].to_numpy(), cutoff)
        return pd.DataFrame({"group": frame["group"].iloc[0], "old": list(out), "new": list(out.values())})

    return clusters.groupBy("group").applyInPandas(merge, "group string, old string, new string")


def merge_in_rounds(clusters: DataFrame, cutoff: float) -> DataFrame:
    """clusters(group, id, n, total) -> (group, old, new): merge_in_task() over a table, for groups too large for a task, until those are small enough."""
    root, step = store.folder(clusters.sparkSession), 0
    live = store.written(clusters, root, "live0")
    names = store.written(live.select("group", F.col("id").alias("old"), F.col("id").alias("new")), root, "names0")
    sides = store.written(live.groupBy("group").agg(F.ceil(F.count("*") / F.lit(SIDE)).alias("k")), root, "sides")
    asked, kept = live, None
    while True:
        step += 1
        found = _cells(asked, live, sides, cutoff)
        near = store.written(found if kept is None else found.union(kept), root, f"near{step}")
        back = near.select("group", F.col("near").alias("id"), F.col("id").alias("near"))
        mutual = near.join(back, ["group", "id", "near"]).where("id < near")
        second = F.startswith("near", F.lit("E"))
        moved = mutual.select("group", F.when(second, F.col("near")).otherwise(F.col("id")).alias("keep"), F.when(second, F.col("id")).otherwise(F.col("near")).alias("lose"))
        moved = store.written(moved, root, f"moved{step}")
        if moved.isEmpty():
            return names
        # Clusters without a neighbour in reach stay as they are and leave the table.
        still = live.join(near.select("group", "id"), ["group", "id"])
        to = still.join(moved.select("group", F.col("lose").alias("id"), "keep"), ["group", "id"], "left").withColumn("into", F.coalesce("keep", "id"))
        total = F.when(F.count("*") == 1, F.first("total")).otherwise(F.zip_with(F.min_by("total", "id"), F.max_by("total", "id"), lambda a, b: a + b))
        live = store.written(to.groupBy("group", "into").agg(F.sum("n").alias("n"), total.alias("total")).select("group", F.col("into").alias("id"), "n", "total"), root, f"live{step}")
        names = store.written(names.join(moved.select("group", F.col("lose").alias("new"), "keep"), ["group", "new"], "left").select("group", "old", F.coalesce("keep", "new").alias("new")), root, f"names{step}")
        if live.groupBy("group").count().where(F.col("count") > TASK).isEmpty():
            last = _in_tasks(live, cutoff).select("group", F.col("old").alias("new"), F.col("new").alias("keep"))
            return names.join(last, ["group", "new"], "left").select("group", "old", F.coalesce("keep", "new").alias("new"))
        touched = store.written(moved.select("group", F.col("keep").alias("id")).union(moved.select("group", "lose")), root, f"touched{step}")
        free = near.join(touched, ["group", "id"], "left_anti")
        kept = free.join(touched.select("group", F.col("id").alias("near")), ["group", "near"], "left_anti").select("group", "id", "near")
        kept = store.written(kept, root, f"kept{step}")
        asked = live.join(kept.select("group", "id"), ["group", "id"], "left_anti")


def average_link(vectors: DataFrame, cutoff: float, group: str | None = None) -> DataFrame:
    """vectors(query_id, kb_link, embedding[, group]) -> (query_id, kb_link) after average-link clustering of the links by the
    mean cosine of their members, while it reaches the cutoff; two entries of the knowledge base never merge, and a NIL
    that merges with one takes its id. Clusters meet within a group only, in which all mentions of a link stand.

    The mean of all pairs of members of two clusters is the product of the means of their unit vectors, so neither pairs of
    mentions nor of clusters are stored. A group of up to TASK clusters is merged in one task; larger ones in rounds over
    a written table. Mentions without a vector keep their link.
    """
    root = store.folder(vectors.sparkSession)
    clusters = store.written(cluster_vectors(vectors, group), root, "clusters")
    sizes = store.written(clusters.groupBy("group").agg(F.count("*").alias("clusters")), root, "sizes")
    large = sizes.where(F.col("clusters") > TASK).select("group")
    names = _in_tasks(clusters.join(large, "group", "left_anti"), cutoff)
    if not large.isEmpty():
        names = names.union(merge_in_rounds(clusters.join(large, "group", "left_semi"), cutoff))
    of = vectors.select("query_id", "kb_link", (F.col(group) if group else F.lit(0)).cast("string").alias("group"))
    moved = store.written(names.where("old <> new"), root, "names")
    return of.join(moved.withColumnRenamed("old", "kb_link"), ["group", "kb_link"], "left").select("query_id", F.coalesce("new", "kb_link").alias("kb_link"))
