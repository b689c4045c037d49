"""SimHash groups against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from anchorage.llm import simhash
from anchorage.llm.components import connected_components
from anchorage.llm.store import Scratch


def plain(text):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def groups(fps, radius=3):
    """Smallest index reachable, by all pairs."""
    label = list(range(len(fps)))
    near = np.bitwise_count(np.array(fps, dtype=np.uint64)[:, None] ^ np.array(fps, dtype=np.uint64)[None, :]) <= radius
    changed = True
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(fps))]
        changed, label = new != label, new
    return label


def test_fingerprint_is_the_plain_one():
    for t in [None, "", "  ", "One", "one two", "A b\tc\x0bd É é", "x " * 500, " a b c"]:
        assert simhash.fingerprint(t) == plain(t)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


def clustered(n, seed, dense=0):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    while len(fps) < 3 * n:
        x = rng.choice(fps)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    centre = rng.getrandbits(64)
    fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(dense)]
    return list(dict.fromkeys(fps))


def frame(spark, fps):
    return spark.createDataFrame([(int(np.uint64(x).view(np.int64)), i) for i, x in enumerate(fps)], "fp long, id long")


@pytest.mark.parametrize("leaf,dense,trees", [(8192, 0, 2), (10, 300, 2), (100, 900, 2), (8192, 900, 2), (100, 0, 1), (30, 200, 3)])
def test_links_lose_nothing(spark, leaf, dense, trees):
    fps = clustered(200, leaf + dense, dense)
    scratch = Scratch(spark)
    comp = connected_components(scratch, simhash.links(scratch, frame(spark, fps), leaf=leaf, trees=trees))
    got = {r.node: r.component for r in comp.collect()}
    assert [got.get(i, i) for i in range(len(fps))] == groups(fps)


def test_vantage_points_make_the_shards(spark):
    """Shards come from the distances alone; a pair within the radius shares one, and a random pair hardly ever does."""
    fps = clustered(600, 5)
    held = {}
    for r in simhash.shards(frame(spark, fps), 9).collect():
        held.setdefault(r.id, set()).add((r.tree, r.cell))
    near = np.bitwise_count(np.array(fps, dtype=np.uint64)[:, None] ^ np.array(fps, dtype=np.uint64)[None, :])
    assert all(held[i] & held[j] for i, j in zip(*np.nonzero(near <= 3)))
    far = [bool(held[i] & held[j]) for i, j in zip(*np.nonzero(near > 20))]
    assert sum(far) < 0.05 * len(far)
    # Without vantage points there is one shard for each tree; each further one parts the shards again.
    sizes = [simhash.shards(frame(spark, fps), k).select("tree", "cell").distinct().count() for k in (0, 1, 3)]
    assert sizes[0] == 2 < sizes[1] < sizes[2]


def test_in_memory_tree():
    for mask, reach, seed in ((-1, None, 1), ((1 << 32) - 1, 1, 2)):
        fps = np.array(clustered(900, seed, 600), dtype=np.uint64)
        if reach == 1:
            fps = np.concatenate([fps, fps[:700] & np.uint64(~((1 << 32) - 1) & (1 << 64) - 1)])
            fps = np.unique(fps)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :])
        near = (near <= 3) & (np.bitwise_count((fps[:, None] ^ fps[None, :]) & np.uint64(mask & (1 << 64) - 1)) <= (3 if reach is None else reach))
        forest = simhash.Forest()
        simhash._linked(fps, np.arange(len(fps)), 3, forest, mask, reach)
        assert all(forest.root(int(i)) == forest.root(int(j)) for i, j in zip(*np.nonzero(near)))


def test_documents(spark, docs, sf):
    rows = [(7, None, "a"), (3, "", "a"), (9, " \t", "a"), (5, "one two three four", "b"), (4, "ONE two\nthree  four", "b"), (4, "ONE two\nthree  four", "b"), (None, "one two three four", "b"), (8, "word " * 20000, "c")]
    got = Counter(map(tuple, simhash.near_duplicates(docs(rows)).select("doc_id", "component_id").collect()))
    assert got == Counter([(7, 3), (3, 3), (9, 3), (5, 4), (4, 4), (4, 4), (None, 4), (8, 8)])
    assert simhash.near_duplicates(docs([])).count() == 0
    table = spark.read.parquet(f"{sf}/documents.parquet")
    own = sorted(table.select("doc_id", "text").collect())
    fps = [plain(r.text) for r in own]
    want = {own[i].doc_id: own[j].doc_id for i, j in enumerate(groups(fps))}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()} == want


def test_components_of_odd_edges(spark):
    e = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (None, 2), (9, 3), (10, 11), (12, 11), (12, 13)], "a long, b long")
    assert {r.node: r.component for r in connected_components(Scratch(spark), e).collect()} == {3: 2, 9: 2, 11: 10, 12: 10, 13: 10}
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(Scratch(spark), chain).collect()} == {0}
