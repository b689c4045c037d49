"""The pipeline: its stages on odd rows, its near-duplicate stage against all pairs, its run."""

import random
from itertools import combinations

import corpus_pipeline


def test_near_dedup_against_all_pairs(spark, sf, docs):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = list(rng.choice(rows)[1].split()) if rows and rng.random() < 0.5 else [f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "s"))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t, _ in rows]
    label = list(range(60))
    for _ in label:
        for a, b in combinations(range(60), 2):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    odd = [(60, None, "s"), (61, "", "s"), (62, "two words", "s"), (63, "Two  words", "s"), (None, rows[0][1], "s")]
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows + odd), sf).collect()]
    want = [i for i in range(60) if label[i] == i]
    assert len(want) < 50
    assert sorted(kept, key=lambda x: (x is None, x)) == [*want, 60, 62, None]


ODD = [(1, None, "a"), (2, "", None), (3, "some words of a short text", "b"), (3, "some words of a short text", "b"), (None, "some words of a short text", "b"), (4, "Some words of\na short text", "c"), (5, "x " * 3000, "c")]


def stage(name):
    return next(f for n, f in corpus_pipeline.STAGES if n == name)


def tables(spark, folder, labels=(), items=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_odd_rows_and_empty_tables(spark, docs, tmp_path):
    sf_dir = tables(spark, tmp_path)
    for name, f in corpus_pipeline.STAGES[:-1]:
        table = docs(ODD)
        out = f(spark, table, sf_dir)
        assert out.columns == table.columns and out.dtypes == table.dtypes
        kept = out.collect()
        if name != "SimHash near-dedup":
            assert len(kept) == len(ODD), name  # no labels, no items, no line that two documents have
        assert f(spark, docs([]), sf_dir).count() == 0
    kept = [(r.doc_id, r.text) for r in stage("SimHash near-dedup")(spark, docs(ODD), sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([ODD[0][:2], ODD[2][:2], ODD[3][:2], ODD[4][:2], ODD[6][:2]], key=str)
    mixed = stage("mixing to target weights")(spark, docs(ODD), sf_dir)
    assert mixed.count() == len(ODD) and stage("mixing to target weights")(spark, docs([]), sf_dir).count() == 0


def test_texts_under_one_doc_id_are_told_apart(spark, docs, tmp_path):
    rng = random.Random(2)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(2))
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, b, "s")]
    kept = stage("SimHash near-dedup")(spark, docs(rows), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (2, b)])


def test_stages_decide(spark, docs, tmp_path):
    rng = random.Random(3)
    other = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item = other(20)
    sf_dir = tables(spark, tmp_path, [(i, i % 2, 0) for i in range(400)], [("i", item), ("none", None), ("i", item)])
    rows = [(i, other(30) if i % 2 else "spam " * 30 + other(3), "s") for i in range(400)]
    good = {r.doc_id for r in stage("quality classifier")(spark, docs(rows), sf_dir).collect()}
    assert len(good & set(range(1, 400, 2))) > 190 and len(good & set(range(0, 400, 2))) < 10
    clean = [(1, other(50), "s"), (2, other(20) + " " + item.upper().replace(" ", "-") + " " + other(20), "s"), (3, other(300) + " " + " ".join(item.split()[:13]) + " " + other(300), "s")]
    assert {r.doc_id for r in stage("benchmark decontamination")(spark, docs(clean), sf_dir).collect()} == {1, 3}
    shared = "a line that two hold"
    out = {r.doc_id: (r.text, r.n_chars) for r in stage("line dedup")(spark, docs([(1, shared + "\nx", "s"), (2, "y\n  " + shared.upper(), "s")]), sf_dir).collect()}
    assert out == {1: (shared + "\nx", len(shared) + 2), 2: ("y", 1)}


def test_run_is_its_stages(spark, sf):
    """The whole run against its stages one after another, and each stage keeps rows of its input as they are but for its own columns."""
    table = docs0 = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in table.collect()}
        table = spark.createDataFrame(f(spark, table, sf).collect(), docs0.schema)
        for r in table.collect():
            assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
            assert name == "line dedup" or r.text == before[r.doc_id].text
    want = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, table, sf).collect()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == want and 0 < len(got) < docs0.count()
