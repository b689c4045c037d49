"""Centroid clustering with whole numbers: block-norm screening in front of exact distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Components in a segment of a compressed vector.
SEGMENT = 8
#: Components reach from -LIMIT to LIMIT: 64 squared differences stay below 2^63.
LIMIT = 1 << 27
#: Vectors that a task holds at once.
STEP = 16384


def whole_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id, v array<int>, short array<double>): floor(scale * x) of each component, and
    the compressed vector: of each segment the mean, times the root of its length, and the norm of what the mean leaves.

    Vectors of another length than dim, null, or with a null or non-finite component take no part; nor do those with a
    component beyond LIMIT, whose distances a long does not hold.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(LIMIT)))
    kept = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull()).where((F.size("embedding") == dim) & fine)
    whole = kept.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = _short(_matrix(batch.column("v"), dim))
            yield batch.append_column("short", _lists(short))

    return whole.mapInArrow(compressed, "vec_id long, v array<int>, short array<double>")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())


def _short(v: np.ndarray) -> np.ndarray:
    """Compressed vectors: means part by segment, then residual norms by segment."""
    cuts = np.arange(0, v.shape[1], SEGMENT)
    lengths = np.diff(np.append(cuts, v.shape[1]))
    x = v.astype(np.float64)
    mean = np.add.reduceat(x, cuts, axis=1) / lengths
    rest = np.add.reduceat((x - np.repeat(mean, lengths, axis=1)) ** 2, cuts, axis=1)
    return np.concatenate([mean * np.sqrt(lengths), np.sqrt(rest)], axis=1)


def nearest(v: np.ndarray, short: np.ndarray, centroids: np.ndarray, short_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row and its exact squared distance, ties to the smaller number; the number of exact distances.

    By Cauchy-Schwarz two segments are no nearer than their compressed forms. Each row first meets exactly the centroid of
    its least bound; after that only centroids whose bound does not exceed the best distance so far.
    """
    s = (short**2).sum(axis=1)
    low = s[:, None] + (short_centroids**2).sum(axis=1)[None, :] - 2 * (short @ short_centroids.T)
    # What rounding can add to a bound: some hundred operations on numbers up to the sum of both squares.
    low -= 1e-12 * (s[:, None] + (short_centroids**2).sum(axis=1)[None, :]) + 1
    first = low.argmin(axis=1)
    number, best = first.copy(), ((v - centroids[first]) ** 2).sum(axis=1)
    exact = len(v)
    for k in range(len(centroids)):
        open_ = np.flatnonzero((low[:, k] <= best) & (first != k))
        if len(open_):
            exact += len(open_)
            d = ((v[open_] - centroids[k]) ** 2).sum(axis=1)
            won = (d < best[open_]) | ((d == best[open_]) & (k < number[open_]))
            number[open_[won]], best[open_[won]] = k, d[won]
    return number, best, exact


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    v = _matrix(batch.column("v"), centroids.shape[1]).astype(np.int64)
    return v, *nearest(v, _matrix(batch.column("short"), short.shape[1]), centroids, short)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            yield batch.slice(a, STEP)


def cluster_sums(whole: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors, componentwise sums) of the non-empty clusters. A task adds up its own rows, so that a large cluster
    sends no more rows than any other; sums of sums are decimals, which do not overflow."""
    k, dim = centroids.shape
    short = _short(centroids)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in _steps(batches):
            v, number, _, _ = _assigned(batch, centroids, short)
            n += np.bincount(number, minlength=k)
            for c in np.unique(number):
                total[c] += v[number == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), _lists(total[some])], ["cluster", "n", "total"])

    parts = whole.select("v", "short").mapInArrow(summed, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("i", "t")).groupBy("cluster", "i")
    out: dict[int, tuple[int, list[int]]] = {}
    # No more than k * dim rows.
    for r in each.agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(20,0)")).alias("t")).collect():
        out.setdefault(r["cluster"], (r["n"], [0] * dim))[1][r["i"]] = int(r["t"])
    return [(c, n, total) for c, (n, total) in out.items()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>).

    Lloyd's algorithm in whole numbers: exact squared distances, ties to the smaller cluster, floor of exact means. The
    first centroids are the k vectors with the smallest sha256 of `salt:vec_id`, in that order; equal hashes (a repeated
    vec_id) go by the vector's components. A cluster without vectors keeps its centroid, and once no centroid moves the
    rounds left are skipped, as they would change nothing. The vectors are written once, with their compressed forms;
    every round is one pass over them that brings k sums to the driver.

    Repeated rows count each time. A vector without vec_id is assigned like any other but is never a first centroid. With
    fewer than k vectors there are fewer clusters, with none an empty result. Inertias beyond a long are null.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    whole = scratch.put(whole_vectors(vectors, dim, scale))
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    heads = whole.where(F.col("vec_id").isNotNull()).select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    if not heads:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.array([r["v"] for r in heads], dtype=np.int64)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, n, total in cluster_sums(whole, centroids):
            moved[c] = [t // n for t in total]
        if (moved == centroids).all():
            break
        centroids = moved
    short = _short(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            _, number, best, _ = _assigned(batch, centroids, short)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    out = scratch.put(whole.mapInArrow(assigned, "vec_id long, cluster int, distance long"))
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    held = lambda s: s if s < 1 << 63 else None
    facts = [(c, held(s), held(sum(sums.values())), centroids[c].tolist()) for c, s in sorted(sums.items())]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # No more than k rows.
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(clustered: DataFrame) -> DataFrame:
    """cluster()'s rows with centroid_sha256, of the final centroid's components as decimal integers joined by commas."""
    text = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text.cast("binary"), 256).alias("centroid_sha256"))


def _round(i: int) -> str:
    return f"""
a{i} as materialized (
  select vec_id, row_id, v, arg_min(c, (d, c)) as c, min(d) as d
  from (select w.vec_id, w.row_id, w.v, m.c, list_sum([(w.v[j] - m.v[j]) * (w.v[j] - m.v[j]) for j in range(1, 65)]) as d from w, m{i} m) group by all
)"""


def _moved(i: int) -> str:
    return f"""
m{i + 1} as materialized (
  select m.c, coalesce(n.v, m.v) as v
  from m{i} m left join (
    select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as v
    from (select a.c, r.j, sum(a.v[r.j]) as s, count(*) as n from a{i} a, (select unnest(range(1, 65)) as j) r group by a.c, r.j) group by c
  ) n on n.c = m.c
)"""


ORACLE = (
    """
with w as materialized (
  select vec_id, row_number() over () as row_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), m0 as materialized (
  select cast(row_number() over (order by h, v) - 1 as integer) as c, v
  from (select v, sha256('3:' || vec_id) as h from w where vec_id is not null order by h, v limit 8)
),"""
    + ",".join(_round(i) + "," + _moved(i) for i in range(10))
    + ","
    + _round(10)
    + """
select a.vec_id, a.c as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia,
  cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(m.v, ',')) as centroid_sha256
from a10 a join m10 m on m.c = a.c
"""
)
