"""SimHash fingerprints, and near-duplicate groups by vantage-point trees over them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .groups import Forest, whole_runs
from .store import Scratch

SEED = 42
#: Shingles hashed before their bits are summed; bounds the memory a very long text takes.
CHUNK = 1 << 16
#: Distances of a ring round a vantage point.
RING = 4


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lower-cased, words parted by ASCII white space), unsigned."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        h = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp): one row for each row, fp as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", of("text").alias("fp"))


def _vantage_points(n: int) -> list[int]:
    """Signed 64-bit codewords in general position, the same in every run."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"vantage {i}", SEED)).view(np.int64)) for i in range(n)]


def _masks(trees: int) -> list[int]:
    """The bits of each tree's metric: 64 bits in `trees` stretches."""
    edges = [round(64 * i / trees) for i in range(trees + 1)]
    return [int(np.uint64(sum(1 << b for b in range(edges[i], edges[i + 1]))).view(np.int64)) for i in range(trees)]


def _blocks(fps: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """The links between two sets of one shard."""
    for at in range(0, len(a), 1024):
        for lo in range(0, len(b), 4096):
            near = np.bitwise_count(fps[a[at : at + 1024], None] ^ fps[None, b[lo : lo + 4096]]) <= radius
            for i, j in zip(*np.nonzero(near), strict=True):
                forest.unite(ids[a[at + i]].item(), ids[b[lo + j]].item())


def _linked(fps: np.ndarray, ids: np.ndarray, radius: int, forest: Forest, mask: int = -1, reach: int | None = None) -> None:
    """All links of one shard, united in the forest, found through an in-memory vantage-point tree.

    Distances to vantage points are over the mask's bits, of which linked points differ in at most `reach`; points that
    are all alike there are parted over all bits.
    """
    bits, reach = np.uint64(mask & (1 << 64) - 1), radius if reach is None else reach
    stack = [(np.arange(len(fps)), bits != np.uint64((1 << 64) - 1))]
    while stack:
        own, masked = stack.pop()
        if len(own) <= 256:
            x = fps[own]
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                forest.unite(ids[own[i]].item(), ids[own[j]].item())
            continue
        far = fps[own] ^ fps[own[0]]
        if masked:
            d = np.bitwise_count(far & bits).astype(np.int64)
            mu = min(int(np.median(d)), int(d.max()) - 1)
            if mu < 0:
                stack.append((own, False))
                continue
            inner, outer = d <= mu, d > mu
            stack += [(own[inner], True), (own[outer], True)]
            # Triangle bound: a pair across the sphere lies within its reach on both sides.
            _blocks(fps, ids, own[inner & (d > mu - reach)], own[outer & (d <= mu + reach)], radius, forest)
            continue
        d = np.bitwise_count(far).astype(np.int64)
        mu = max(int(np.median(d)), radius)
        if mu == radius or d.max() <= mu:
            # The inner ball is one component through its centre, whatever else links there.
            for i in np.flatnonzero(d <= radius):
                forest.unite(ids[own[0]].item(), ids[own[i]].item())
            inner, outer = own[d <= radius], own[d > radius]
            rim = outer[d[d > radius] <= 2 * radius]
            for at in range(0, len(rim), 1024):  # rim against ball, in blocks
                for lo in range(0, len(inner), 4096):
                    near = np.bitwise_count(fps[rim[at : at + 1024], None] ^ fps[None, inner[lo : lo + 4096]]) <= radius
                    for i in np.flatnonzero(near.any(axis=1)):
                        forest.unite(ids[rim[at + i]].item(), ids[own[0]].item())
            if len(outer):
                stack.append((outer, False))
            continue
        inner, outer = d <= mu, d > mu
        stack += [(own[inner], False), (own[outer], False)]
        _blocks(fps, ids, own[inner & (d > mu - radius)], own[outer & (d <= mu + radius)], radius, forest)


def shards(points: DataFrame, levels: int, radius: int = 3, trees: int = 2, ring: int = RING) -> DataFrame:
    """points(fp, id) -> (fp, id, tree, mask, cell): each point in every shard of a tree that it has to be in.

    A tree's metric is the Hamming distance over one of `trees` stretches of bits. Two fingerprints within the radius differ
    in at most reach = radius // trees bits of some stretch, and by the triangle inequality their distances to any vantage
    point differ by no more. Each level has one vantage point and parts a node into rings of `ring` distances; a point
    within `reach` below the edge of its ring stands in the next ring too, so both points of such a pair share a shard
    at every level and all other branches are pruned for them.
    """
    reach = radius // trees
    metric = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(m).alias("mask")) for t, m in enumerate(_masks(trees))]))
    at = points.select("fp", "id", metric.alias("m")).select("fp", "id", "m.*")
    cells = F.array(F.lit(0).cast("long"))
    for v in _vantage_points(levels):
        d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(v)).bitwiseAND(F.col("mask")))
        cells = F.flatten(F.transform(cells, _below(F.sequence(F.floor(d / ring), F.floor((d + reach) / ring)))))
    return at.select("fp", "id", "tree", "mask", F.explode(cells).alias("cell"))


def _below(rings: Column):
    """A node's children in some rings."""
    return lambda node: F.transform(rings, lambda r: F.xxhash64(node, r))


def _share(bits: int, reach: int, ring: int) -> float:
    """What share of a node's points a shard of it has, on average over the shards' points, if fingerprints are random."""
    held: Counter = Counter()
    for d in range(bits + 1):
        for c in range(d // ring, (d + reach) // ring + 1):
            held[c] += math.comb(bits, d) / 2**bits
    return sum(q * q for q in held.values()) / sum(held.values())


def _levels(n: int, leaf: int, radius: int = 3, trees: int = 2) -> int:
    """Levels after which a shard of random fingerprints has about `leaf` points."""
    return max(0, math.ceil(math.log(max(n, 1) / leaf) / -math.log(_share(64 // trees, radius // trees, RING))))


def links(scratch: Scratch, points: DataFrame, radius: int = 3, trees: int = 2, leaf: int = 2048) -> DataFrame:
    """points(fp, id), distinct fingerprints -> links(a, b) that join all pairs within the radius; a spanning forest of each shard.

    The distributed levels are shards(), as many as the number of points asks for. (One tree over all 64 bits would do
    with no more than the radius, but random distances crowd round 32 with a deviation of 4, so radius 3 would put some
    60 % of the points on both sides of each sphere; over 32 bits the reach is 1 and the deviation 2.8, so a level puts
    a fourth of them in two rings and leaves 0.44 of a node to a shard.) A shard that still holds over 4 leaves is split
    by spheres round one of its own points, see _split_crowded(). Within a shard the tree goes on in memory.
    """
    points = points.where("id is not null")
    placed = at = scratch.put(shards(points, _levels(points.count(), leaf, radius, trees), radius, trees).drop("mask"))
    edges = None
    crowded = at.groupBy("tree", "cell").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("fp").alias("h"), F.col("fp").alias("v"), F.col("id").alias("vid"))).alias("c")).where(F.col("n") > 4 * leaf)
    crowded = scratch.put(crowded.select("tree", "cell", "n", "c.v", "c.vid"))
    if not crowded.isEmpty():
        at, edges = _split_crowded(scratch, at, crowded, radius, 4 * leaf)
    masks = _masks(trees)
    reach = radius // trees

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_runs(batches, ["tree", "cell"]):
            fps, ids, tree, forest = frame["fp"].to_numpy().view(np.uint64), frame["id"].to_numpy(), frame["tree"].to_numpy(), Forest()
            sizes = np.diff(starts)
            ends = np.repeat(starts[1:], sizes)
            small = np.repeat(sizes <= 256, sizes)
            for k in range(1, int(sizes[sizes <= 256].max(initial=1))):
                i = np.flatnonzero(small[:-k] & (np.arange(len(fps) - k) + k < ends[:-k])) if k < len(fps) else []
                if not len(i):
                    break
                for j in i[np.bitwise_count(fps[i] ^ fps[i + k]) <= radius]:
                    forest.unite(ids[j].item(), ids[j + k].item())
            for g in np.flatnonzero(sizes > 256):
                a, z = starts[g], starts[g + 1]
                _linked(fps[a:z], ids[a:z], radius, forest, masks[tree[a]], reach)
            if forest.links:
                yield pd.DataFrame(forest.links, columns=["a", "b"])

    found = at.repartition("tree", "cell").sortWithinPartitions("tree", "cell").mapInPandas(run, "a long, b long")
    found = scratch.put(found if edges is None else found.union(edges))
    scratch.drop(placed)
    return found


def _split_crowded(scratch: Scratch, at: DataFrame, crowded: DataFrame, radius: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """Splits shards of over `shard` points by spheres in the full metric, as long as that makes the largest smaller; also the links of each centre to its ball.

    What resists, points all within a few bits of each other, stays one shard, whose task links it in memory."""
    done, edges = at.join(crowded.select("tree", "cell"), ["tree", "cell"], "left_anti").select("fp", "id", "tree", "cell"), None
    largest, step = crowded.agg(F.max("n")).first()[0], 0
    hot = scratch.put(at.join(crowded.drop("n"), ["tree", "cell"]))
    while True:
        step += 1
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))).alias("d")
        hot = hot.select("fp", "id", "tree", "cell", "v", "vid", d)
        star = hot.where((F.col("d") <= radius) & (F.col("id") != F.col("vid"))).select(F.col("vid").alias("a"), F.col("id").alias("b"))
        edges = star if edges is None else edges.union(star)
        mid = scratch.put(hot.groupBy("tree", "cell").agg(F.greatest(F.expr("percentile_approx(d, 0.5)"), F.lit(radius)).alias("mu")))
        # A sphere of the query radius needs no inner shard: its ball is one component through the centre.
        part = F.filter(F.array(
            F.when((F.col("d") <= F.col("mu")) & (F.col("mu") > radius), F.lit("in")),
            F.when(F.col("d") > F.col("mu"), F.lit("out")),
            F.when((F.col("d") > F.col("mu") - radius) & (F.col("d") <= F.col("mu") + radius), F.lit("rim")),
        ), lambda x: x.isNotNull())
        spread = hot.join(mid, ["tree", "cell"]).select("fp", "id", "tree", F.col("cell").alias("old"), F.explode(part).alias("side"))
        spread = spread.select("fp", "id", "tree", F.xxhash64("old", F.lit(step), "side").alias("cell"))
        size = spread.groupBy("tree", "cell").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("fp", F.lit(step)).alias("h"), F.col("fp").alias("v"), F.col("id").alias("vid"))).alias("c"))
        size = scratch.put(size.select("tree", "cell", "n", "c.v", "c.vid"))
        hot = scratch.put(spread.join(size, ["tree", "cell"]))
        most = size.agg(F.max("n")).first()[0]
        if most <= shard or most >= largest:
            return done.union(hot.select("fp", "id", "tree", "cell")), edges
        largest = most
        done = done.union(hot.where(F.col("n") <= shard).select("fp", "id", "tree", "cell"))
        hot = hot.where(F.col("n") > shard)


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, trees: int = 2) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp, component_id), one row for each row of docs.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most `radius` bits. Null, empty
    and wordless texts have fingerprint 0. Equal fingerprints are one point, so any number of copies costs one. Rows
    with a null doc_id get a fingerprint and the component of it, and link nothing themselves; repeated rows come back
    each. An empty table gives none. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    return grouped(scratch, scratch.put(fingerprints(docs, width)), radius, trees)


def grouped(scratch: Scratch, rows: DataFrame, radius: int = 3, trees: int = 2) -> DataFrame:
    """rows(doc_id, fp), written -> (doc_id, fp, component_id); doc_id of any orderable type. See near_duplicates()."""
    points = scratch.put(rows.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("id", F.when(F.col("first").isNotNull(), F.monotonically_increasing_id())))
    comp = connected_components(scratch, links(scratch, points.select("fp", "id"), radius, trees))
    # Least doc_ids are taken of numbered points, as numbers keep the rows of the trees short whatever a doc_id is.
    comp = points.select("id", "first").join(comp, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("component", "id").alias("c"))
    least = scratch.put(comp.where("id is not null").groupBy("c").agg(F.min("first").alias("component_id")))
    named = scratch.put(comp.join(least, "c", "left").select("id", "component_id"))
    # Written, so that the join with rows can split a fingerprint that very many of them have.
    label = scratch.put(points.join(named.where("id is not null"), "id", "left").select("fp", "component_id"))
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")
