"""Identifiers and clusters of mentions that link to nothing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import store


def allocate(rows: DataFrame, consumed: str = "consumed", width: int = 1 << 16) -> DataFrame:
    """rows(pos, consumed, ...) -> with nil_id, NIL and a running number over pos; null where nothing is consumed.

    A row that consumes two (a linked entity that the knowledge base lacks burns one) gets the second. The running sum goes
    over stretches of `width` positions and the sums of all stretches before, not over one partition.
    """
    r = rows.withColumn("__stretch", F.floor(F.col("pos") / width))
    sums = r.groupBy("__stretch").agg(F.sum(consumed).alias("__sum"))
    before = Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__stretch", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    number = F.col("__base") + F.sum(consumed).over(own) - 1
    out = r.join(base, "__stretch")  # with a row for each stretch of positions, which Spark broadcasts if they are few
    return out.withColumn("nil_id", F.when(F.col(consumed) > 0, F.format_string("NIL%04d", number.cast("long")))).drop("__stretch", "__base")


def cluster_exact(answers: DataFrame) -> DataFrame:
    """answers(pos, query_id, name, entity, kb_link, confidence) -> the same, unlinked mentions of one expanded entity string under one id.

    An entity string is a key if some unlinked mention reached it from another name; its id is the first in pos order.
    Every unlinked mention with that string then has this id, at confidence 0.6.
    """
    nil = F.startswith("kb_link", F.lit("NIL"))
    keys = answers.where(nil & (F.col("entity") != F.col("name"))).groupBy("entity").agg(F.min_by("kb_link", "pos").alias("__first"))
    out = answers.join(keys, "entity", "left")
    hit = nil & F.col("__first").isNotNull()
    return out.withColumns({"kb_link": F.when(hit, F.col("__first")).otherwise(F.col("kb_link")), "confidence": F.when(hit, F.lit(0.6)).otherwise(F.col("confidence"))}).drop("__first").select(answers.columns)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): least reachable node, by min labels with pointer jumping; each round is written to the shared folder."""
    root = store.folder(edges.sparkSession)
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).toDF("n", "m").distinct()
    both = store.written(both, root, "edges")
    label, step = store.written(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("c")), root, "0"), 0
    while True:
        step += 1
        near = store.written(both.join(label.toDF("m", "c"), "m").groupBy("n").agg(F.min("c").alias("x")), root, f"near{step}")
        new = label.join(near, "n").select("n", F.least("c", "x").alias("c"))
        jump = store.written(new.join(new.toDF("__n", "__c"), F.col("c") == F.col("__n"), "left").select("n", F.coalesce("__c", "c").alias("c")), root, str(step))
        if jump.join(label.toDF("n", "old"), "n").where("c <> old").isEmpty():
            return jump.toDF("node", "component")
        label = jump


def _kept(a: str, b: str) -> tuple[str, str]:
    """Of two clusters the id that stays and the one that goes: the first stays unless the second is of the knowledge base."""
    return (b, a) if b.startswith("E") else (a, b)


def agglomerate(ids: list[str], pairs: dict[tuple[str, str], tuple[float, int]], cutoff: float) -> dict[str, str]:
    """Average-link merging of clusters, the most similar pair with a NIL first, while it reaches the cutoff -> id of each cluster.

    pairs hold sum and count of the members' similarities, which add up when clusters merge. Ties go to the smaller ids.
    Pairs wait in a heap; one that a merge has changed is passed over when its turn comes.
    """
    near: dict[str, dict[str, tuple[float, int]]] = {i: {} for i in ids}
    heap: list[tuple[float, str, str]] = []

    def put(a: str, b: str, s: float, n: int) -> None:
        near[a][b] = near[b][a] = (s, n)
        if n and s / n >= cutoff and (a.startswith("NIL") or b.startswith("NIL")):
            heapq.heappush(heap, (-s / n, min(a, b), max(a, b)))

    for (a, b), (s, n) in pairs.items():
        put(a, b, s, n)
    members = {i: [i] for i in ids}
    while heap:
        mean, a, b = heapq.heappop(heap)
        s, n = near.get(a, {}).get(b, (0.0, 0))
        if not n or -s / n != mean:
            continue
        keep, lose = _kept(a, b)
        members[keep] += members.pop(lose)
        for x, (s, n) in near.pop(lose).items():
            del near[x][lose]
            if x != keep:
                s0, n0 = near[keep].get(x, (0.0, 0))
                put(keep, x, s0 + s, n0 + n)
    return {i: k for k, own in members.items() for i in own}


def merge_in_rounds(sums: DataFrame, cutoff: float) -> DataFrame:
    """sums(a, b, s, n), a before b -> (old, new): agglomerate() over a table, for components too large for a task.

    In each round all pairs merge that are the best of both their clusters. Average linkage is reducible: no merge brings
    a cluster nearer to another than the nearer of its parts was, so such pairs merge in whatever order pairs are taken.
    """
    spark = sums.sparkSession
    root, step = store.folder(spark), 0
    sums = store.written(sums, root, "sums0")
    names = store.written(sums.select(F.col("a").alias("old")).union(sums.select("b")).distinct().withColumn("new", F.col("old")), root, "names0")
    while True:
        open_ = sums.where((F.col("s") / F.col("n") >= cutoff) & (F.startswith("a", F.lit("NIL")) | F.startswith("b", F.lit("NIL"))))
        open_ = open_.select("a", "b", F.struct((-F.col("s") / F.col("n")).alias("o"), "a", "b").alias("p"))
        best = open_.select(F.col("a").alias("x"), "p").union(open_.select("b", "p")).groupBy("x").agg(F.min("p").alias("p"))
        step += 1
        mutual = best.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where("n = 2")
        second = F.startswith("b", F.lit("E"))
        moved = store.written(mutual.select(F.when(second, F.col("a")).otherwise(F.col("b")).alias("lose"), F.when(second, F.col("b")).otherwise(F.col("a")).alias("keep")), root, f"moved{step}")
        if moved.isEmpty():
            return names
        at = sums
        for c in ("a", "b"):
            at = at.join(moved.toDF(c, "__k"), c, "left").withColumn(c, F.coalesce("__k", c)).drop("__k")
        at = at.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", "n").groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        sums = store.written(at, root, f"sums{step}")
        names = store.written(names.join(moved.toDF("new", "__k"), "new", "left").select("old", F.coalesce("__k", "new").alias("new")), root, f"names{step}")


def cluster_average_link(links: DataFrame, scores: DataFrame, cutoff: float = 0.9999821007, task_pairs: int = 1_000_000) -> DataFrame:
    """links(query_id, kb_link), scores(a, b, sim) over query ids -> (query_id, kb_link) after average-link clustering.

    A mean that reaches the cutoff has a member pair that does, so every merge stays within a connected component of the
    clusters joined by such pairs; each component is merged by itself, in one task if it has up to task_pairs pairs of
    clusters, in rounds over the table if it has more.
    """
    of = links.select("query_id", "kb_link")
    pair = scores.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").where("ca <> cb")
    pair = pair.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "sim")
    root = store.folder(links.sparkSession)
    sums = store.written(pair.groupBy("a", "b").agg(F.sum("sim").alias("s"), F.count("*").alias("n"), F.max("sim").alias("best")), root, "sums")
    comp = components(sums.where(F.col("best") >= cutoff).select("a", "b"))
    inside = sums.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").where("ca = cb").select(F.col("ca").alias("component"), "a", "b", "s", "n")
    inside = store.written(inside, root, "inside")
    large = store.written(inside.groupBy("component").agg(F.count("*").alias("pairs")).where(F.col("pairs") > task_pairs).select("component"), root, "large")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = {(r.a, r.b): (r.s, r.n) for r in pdf.itertuples()}
        out = agglomerate(sorted({x for k in pairs for x in k}), pairs, cutoff)
        return pd.DataFrame({"old": list(out), "new": list(out.values())})

    named = inside.join(large, "component", "left_anti").groupBy("component").applyInPandas(merge, "old string, new string")
    if not large.isEmpty():
        named = named.union(merge_in_rounds(inside.join(large, "component", "left_semi").select("a", "b", "s", "n"), cutoff))
    return of.join(named, F.col("kb_link") == F.col("old"), "left").select("query_id", F.coalesce("new", "kb_link").alias("kb_link"))
