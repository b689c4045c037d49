"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import whole_runs
from .store import Scratch

#: Vectors in a block of candidates, queries in a slice and in a step of it, and leading rotated dimensions summed first.
BLOCK, QUERIES, STEP, LEAD = 4096, 4096, 512, 16
#: Vectors on which the rotation is fitted; any rotation gives exact results, a fitted one prunes more.
SAMPLE = 4096


def quantised(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id, v array<long>): floor(256 x) of each component; rows with a null vector, or
    a null or non-finite component, or without vec_id take no part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return kept.select("vec_id", F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v"))


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    """Integers as doubles, exact to 2^53; shorter vectors end in zeros."""
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _rotation(distinct: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of a bounded sample, in the order of a hash."""
    rows = distinct.orderBy(F.xxhash64("v"), "first").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(rows):
        return np.eye(dim)
    m = _matrix(rows, dim)
    return np.linalg.svd(m.T @ m)[0]


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows with another vec_id. Ties go to the
    smaller vec_id; fewer candidates give fewer rows. Equal vectors are scored once, as only the k + 1 smallest ids of
    each can be in a result. Distinct vectors stand in blocks by descending length. Each query first meets block 0, which
    gives it a threshold, and after that only the blocks whose greatest length times its own can still reach that. Within
    a block, sums over the leading rotated dimensions plus the product of both residual lengths (Cauchy-Schwarz) leave the
    few candidates whose score is computed in full, in whole numbers. Vectors of different lengths meet as if ended by
    zeros. A vec_id that repeats is in the result once for each of its rows; query rows that share one are one query by
    the smallest vector. Null, empty-table and non-finite cases: see quantised().
    """
    scratch = Scratch(vectors.sparkSession)
    base = scratch.put(quantised(vectors))
    ids = Window.partitionBy("v").orderBy("vec_id")
    few = base.withColumn("r", F.row_number().over(ids)).where(F.col("r") <= k + 1)
    norm = F.sqrt(F.aggregate("v", F.lit(0).cast("double"), lambda a, c: a + c * c))
    distinct = scratch.put(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("first")).withColumn("norm", norm))
    stats = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    schema = "query_id long, vec_id long, score long"
    if not stats["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(stats["dim"], 1)
    turn = _rotation(distinct, dim)
    # Blocks are ranges of length, even where very many vectors have the same one.
    ranged = distinct.repartitionByRange(max(1, -(-stats["n"] // BLOCK)), F.desc("norm"), F.xxhash64("v"))
    placed = scratch.put(ranged.withColumn("block", F.spark_partition_id()))
    scratch.drop(distinct)
    # One length for each block of BLOCK vectors or so, in descending order: which blocks a query can reach is a prefix of them.
    heads = placed.groupBy("block").agg(F.max("norm").alias("m")).orderBy("block").collect()
    order, lengths = np.array([r["block"] for r in heads]), np.array([r["m"] for r in heads])
    queries = base.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    queries = scratch.put(queries.withColumn("qnorm", F.sqrt(F.aggregate("q", F.lit(0).cast("double"), lambda a, c: a + c * c))))
    # Queries are dealt over slices, so that no block has all of them in one task, and a block's vectors go to the slices that ask for them.
    queries = queries.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // QUERIES)))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by (block, slice, query_id): a block's candidates, which have no query_id, stand before the slice's queries."""
        for frame, starts in whole_runs(batches, ["block", "slice"]):
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                part = frame.iloc[a:z]
                own = part["ids"].notna().to_numpy()
                cand = _matrix(part["v"][own], dim)
                rot = cand @ turn
                yield from _scan(part[~own], cand, part["ids"][own].to_numpy(), rot, np.sqrt((rot[:, LEAD:] ** 2).sum(axis=1)))

    def _scan(part: pd.DataFrame, cand, firsts, rot, rest) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(part), STEP):
            some = part.iloc[lo : lo + STEP]
            q = _matrix(some["v"], dim)
            qr = q @ turn
            bound = qr[:, :LEAD] @ rot[:, :LEAD].T + np.sqrt((qr[:, LEAD:] ** 2).sum(axis=1))[:, None] * rest[None, :]
            out = []
            for i, (qid, floor) in enumerate(zip(some["query_id"], some["floor"], strict=True)):
                # Rounding moves a bound by far less than this; scores are whole numbers.
                slack = 1e-9 * (abs(floor) + 1) + 0.5 if np.isfinite(floor) else 0.0
                best = np.flatnonzero(bound[i] >= floor - slack)
                score = cand[best] @ q[i]
                if len(best) > 4 * k:
                    # All that score at least the k+1-st best; equal vectors and the query itself need the spare one.
                    least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    keep = score >= least
                    best, score = best[keep], score[keep]
                    order = np.lexsort(([firsts[b][0] for b in best], -score))[: 2 * k + 2]
                    best, score = best[order], score[order]
                # Of a block no more than k can be in a query's result, ties to the smaller vec_id.
                found = sorted((-int(s), v) for b, s in zip(best, score, strict=True) for v in firsts[b] if v != qid)
                out += [(qid, v, -s) for s, v in found[:k]]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def meet(asked: DataFrame, own: DataFrame) -> DataFrame:
        """asked(block, slice, query_id, q, floor) against the candidates own of the same block."""
        null = F.lit(None)
        met = scratch.put(asked.select("block", "slice").distinct())
        left = own.join(met, "block").select("block", "slice", "v", "ids", null.cast("long").alias("query_id"), null.cast("double").alias("floor"))
        right = asked.select("block", "slice", F.col("q").alias("v"), null.cast("array<long>").alias("ids"), "query_id", "floor")
        both = left.union(right).repartition("block", "slice")
        return both.sortWithinPartitions("block", "slice", F.col("query_id").asc_nulls_first()).mapInPandas(search, schema)

    top = int(order[0])
    first = scratch.put(_best(meet(queries.withColumns({"block": F.lit(top), "floor": F.lit(float("-inf"))}), placed.where(F.col("block") == top)), k))
    if len(order) == 1:
        return first.select("query_id", "rank", "vec_id", "score")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("__q"), F.col("score").cast("double").alias("floor"))
    asked = queries.join(floors, F.col("query_id") == F.col("__q"), "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    known = vectors.sparkSession.sparkContext.broadcast((order, -lengths))

    @F.pandas_udf("array<int>")
    def reach(qnorm: pd.Series, floor: pd.Series) -> pd.Series:
        """The blocks after the first whose longest vector can still score the floor (Cauchy-Schwarz)."""
        blocks, less = known.value
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(floor <= 1, -np.inf, (floor - 1) / (qnorm * 1.000001))
        return pd.Series([blocks[1 : max(1, n)] for n in np.searchsorted(less, -need, "right")])

    asked = scratch.put(asked.select("slice", "query_id", "q", "floor", F.explode(reach("qnorm", "floor")).alias("block")))
    rest = meet(asked, placed.where(F.col("block") != top))
    return _best(first.select("query_id", "vec_id", "score").union(rest), k)


ORACLE = r"""
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum([q.e[i] * c.e[i] for i in range(1, least(len(q.e), len(c.e)) + 1)]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
