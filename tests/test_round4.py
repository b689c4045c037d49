"""Findings of round 4."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from anchorage.functions import similarity as sim
from anchorage.operators import coref
from anchorage.plans import annotated
from anchorage.sources import store


def test_stems_and_vectors_are_whole(spark, tmp_path):
    """the stems with their shares and the term vector are in the result, not their lengths alone."""
    rows = [(1, "The ponies agreed, agreed. Ponies 12 x9"), (2, "the of"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entry.queries()["context_stems"](spark, str(tmp_path)).collect()}
    assert [tuple(x) for x in got[1].stems] == [("agre", 0.666667), ("poni", 0.333333)]
    assert [tuple(x) for x in got[1].terms] == [("12", 1), ("Ponies", 1), ("agreed", 2), ("ponies", 1), ("x9", 1)]
    assert (got[1].n_stems, got[1].n_terms) == (2, 5)
    assert (got[2].n_stems, got[2].n_terms, got[2].stems, got[2].terms) == (0, 0, [], [])
    assert (got[3].stems, got[3].terms) == (None, None)


def test_chains_are_made_within_rows(spark, sf, tmp_path, monkeypatch):
    """no entity or name is shuffled or written, and chains are those of the entities as rows; rows of one id are one document, null ids and texts are left out."""
    kept = []
    monkeypatch.setattr(store, "written", lambda df, root, name: kept.append(name) or df)
    want = coref.chains(annotated.merged_entities(spark, sf)).groupBy("doc_id", "type", "chain").agg(F.count("*").alias("n_mentions"), F.countDistinct(F.lower("entity")).alias("n_names")).collect()
    got = annotated.coref_chains(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and not kept
    rows = [(1, "bbbbb Smith ab Smith"), (1, "Smith in ab"), (2, None), (None, "Smith"), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = annotated.coref_chains(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "ORGANIZATION", "ab", 2, 1), (1, "PERSON", "bbbbb smith", 3, 2)]


def test_chain_ends():
    """prefix, suffix and initials, the first longer name before others, at one place by the name."""
    found = [("ORGANIZATION", (0, i), e) for i, e in enumerate(["NYT", "New York Times", "Nice Yellow Tea", "Times", "The New York Times", "nyt"])] + [("PERSON", (0, 1), "b a"), ("PERSON", (0, 1), "a c"), ("PERSON", (2, 0), "A"), ("PERSON", (3, 0), "")]
    assert coref.chain_ends(found[:-1]) == {
        ("ORGANIZATION", "nyt"): "the new york times", ("ORGANIZATION", "new york times"): "the new york times", ("ORGANIZATION", "nice yellow tea"): "nice yellow tea", ("ORGANIZATION", "times"): "the new york times",
        ("ORGANIZATION", "the new york times"): "the new york times", ("PERSON", "b a"): "b a", ("PERSON", "a c"): "a c", ("PERSON", "a"): "a c",
    }
    assert coref.chain_ends([]) == {}


def blocks(vectors, size):
    """Vectors {id: count} as blocks, in the order of their keys."""
    lists = [pa.array([list(f(v)) for v in vectors], pa.list_(pa.int64())) for f in (dict.keys, dict.values)]
    rows = pa.record_batch([pa.array(range(len(vectors))), *lists], names=["key", "ids", "tfs"])
    return [sim._Block([pa.scalar(k), *[c[0] for c in b.columns]], 64) for k, b in enumerate(sim._packed(iter([rows]), size, 10**9))]


@pytest.mark.parametrize(("sparse", "common", "met", "most"), [(10**9, 1, 7, 9), (10**9, 10**9, 7, 9), (10**9, 20, 1 << 20, 5_000_000_000), (0, 1, 7, 9), (8, 20, 7, 5000)])
def test_blocks_against_all_pairs(sparse, common, met, most):
    """F1: whole tiles as matrices or by meetings, pairs one by one, and counts beyond single precision give the same."""
    rng = np.random.default_rng(sparse % 97 + common % 89)
    vectors = []
    for i in range(90):
        like = vectors[rng.integers(i)] if i and rng.random() < 0.5 else {}
        vectors.append({k: v for k, v in like.items() if rng.random() < 0.9} | {int(t): int(n) for t, n in zip(rng.integers(-60, 60, 9), rng.integers(1, most, 9), strict=True)})
    dense = np.array([[v.get(t, 0) for t in range(-60, 60)] for v in vectors], dtype=float)
    norm = np.sqrt((dense**2).sum(axis=1))
    cosine = (dense @ dense.T) / norm[:, None] / norm
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if cosine[i, j] >= 0.6}
    made, got = blocks(vectors, 40), {}
    for i, a in enumerate(made):
        for b in made[i:]:
            for x, y, c in sim._near(a, b, 0.6, 256, 16, sparse, 8, common, met):
                for p, q, s in zip(a.keys[x].tolist(), b.keys[y].tolist(), c.tolist(), strict=True):
                    assert (min(p, q), max(p, q)) not in got
                    got[min(p, q), max(p, q)] = s
    assert set(got) == want and all(abs(got[k] - cosine[k]) < 1e-12 for k in got)


def test_unlike_vectors_do_not_meet(monkeypatch):
    """pairs that share too little are dropped at sight, so that no term of theirs is multiplied."""
    rng = np.random.default_rng(1)
    vectors = [{int(t): 1 for t in rng.integers(-(10**6), 10**6, 40)} for _ in range(200)] + [{5: 9, i: 1} for i in range(10, 15)]
    met = []
    monkeypatch.setattr(sim, "_whole", lambda *a: pytest.fail("no tile has many"))
    keep = sim._single
    monkeypatch.setattr(sim, "_single", lambda a, b, i, j, size: met.append(len(i)) or keep(a, b, i, j, size))
    (a,) = blocks(vectors, 1000)
    assert sum(len(x) for x, _, _ in sim._near(a, a, 0.8, 2048, 512, 160, 1024, 300, 1 << 20)) == 10
    assert sum(met) < 200


def test_vectors_are_read_once(spark):
    """texts are taken apart once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    v = spark.createDataFrame([(i, ["a", f"b{i % 20}"], [9, 1]) for i in range(60)], "doc_id long, terms array<string>, tfs array<long>")
    assert sim.similar_vectors(v.mapInArrow(counted, v.schema), "doc_id", 0.8).count() == 20 * 19 // 2 + 40
    assert seen.value == 60
