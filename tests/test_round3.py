"""Findings of round 3: what is done within a row or once must stay so, with the same results."""

import threading

import duckdb
import pytest

import __spark_entry__ as entry
from anchorage.operators import annotations, candidates
from anchorage.plans import annotated, learning


def shuffles(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ")


def test_tokens_are_not_shuffled(spark, sf):
    """a document's entities and lists are made within its row."""
    for made in (annotated.entities, annotated.entity_lists, annotated.merged_entities, annotated.tokens):
        assert shuffles(made(spark, sf)) == 0


def test_places_and_chain_of_tokens(spark):
    rows = spark.createDataFrame([("a", "aaaa , bbbb in cccc in eeeee"), ("b", None), ("c", "")], "doc_id string, text string")
    got = {r.doc_id: [tuple(e) for e in r.entities] for r in annotations.entities_in(rows, "doc_id", ["text"], annotated.words_of).collect()}
    assert got == {"a": [(0, 0, 4, "LOCATION", "aaaa , bbbb in cccc", 0, 19), (0, 6, 6, "PERSON", "eeeee", 23, 28)], "b": [], "c": [(0, 0, 0, "LOCATION", "", 0, 0)]}


def test_submission_of_long_ids(spark, tmp_path):
    """ids of five digits keep all of them, in the SQL too."""
    spark.createDataFrame([(12345, "s"), (7, "s"), (10000, "t")], "doc_id long, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["submission_file"]).fetchall()
    assert sorted(want) == sorted(map(tuple, entry.queries()["submission_file"](spark, str(tmp_path)).collect())) == [("10000", "Et"), ("12345", "NIL12345"), ("7", "NIL0007")]


def test_titles_meet_once_and_are_not_sent(spark):
    """The letters of titles are never broadcast; entries of one title count each, an entry of two titles once."""
    kb = spark.createDataFrame([(1, "Red Fox"), (1, "red foxes"), (2, "RED FOX"), (3, "red fox"), (4, "hen"), (None, "red fox"), (5, None), (6, "")], "kb_id int, title string")
    names = spark.createDataFrame([("fox",), ("Fox",), ("x",), ("zebra",), ("",), (None,)], "name string")
    got = candidates.ambiguity(names, "name", kb)
    assert sorted(map(tuple, got.collect())) == [("Fox", 3), ("fox", 3), ("x", 3), ("zebra", 0)]
    teams = spark.createDataFrame([("E2", "red fox", "team"), ("E1", "red fox", "club"), ("E0", "Red Fox", "city"), ("E3", "blue fox", "Team")], "kb_id string, title string, wiki_type string")
    assert sorted(map(tuple, learning.teams_named(names, "name", teams).collect())) == [("fox", "E1"), ("x", "E1")]
    n = names.where("name <> ''").select("name", "name").toDF("name", "low")
    met = candidates.titles_holding(n, kb.where("title <> ''").select("title").distinct().selectExpr("title", "lower(title) as low"))
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("search", [lambda r: learning.threshold_search(r, "id", splits=2), lambda r: learning.cross_year(r, "2012", "2011", "id")])
def test_features_are_worked_out_once(spark, search):
    """each row's features are worked out once, however often they are read."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, i % 3 == 0, 0.8 if i % 3 == 0 else 0.1 + (i % 11) / 110, (i % 5) / 5, "2011" if i % 2 else "2012") for i in range(200)], "id long, label boolean, candidate_score double, docsim double, year string")
    search(rows.mapInArrow(counted, rows.schema)).collect()
    assert seen.value == 200


def test_stems_by_slices(spark):
    """more texts than a slice, null and empty ones among them."""
    import pyarrow as pa

    from anchorage.functions import stems

    lists = pa.array([["ponies", "pony", "ponies"], None, []] * 300 + [["a", None]], type=pa.list_(pa.string()))[3:]
    made = stems.stemmed.func(lists)
    assert made.to_pylist() == [["poni", "poni", "poni"], None, []] * 299 + [["a", None]]
    assert stems._shares.func(made[:-1]).to_pylist() == [[("poni", 1.0)], None, []] * 299


def test_places_of_null_and_many(spark):
    """Places come through Arrow in batches, whatever the key's type."""
    from anchorage.operators import occurrences

    rows = spark.createDataFrame([("k", "ab" * 30_000, ["ab", None, "ab", ""]), ("n", None, ["x"]), (None, "x", ["x"]), ("e", "x", [])], "id string, text string, names array<string>")
    found = occurrences.occurrences(rows, "id", "text", "names")
    assert found.count() == 30_000 and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_no_text_is_numbered(spark, sf, monkeypatch):
    """texts take part in the evaluation by their hashes."""
    from anchorage.operators import nil
    from anchorage.plans import queries

    seen, allocate = [], nil.allocate

    def watched(rows):
        seen.extend(rows.selectExpr("max(length(name))", "max(length(entity))").first())
        return allocate(rows)

    monkeypatch.setattr(nil, "allocate", watched)
    queries.passage_link_evaluation(spark, sf).collect()
    assert seen == [64, 64]


def test_terms_are_counted_within_rows(spark):
    """no word is shuffled; rows of one key, a null one too, are still added up."""
    from anchorage.functions import similarity as sim

    rows = [(i, "Red fox, the RED hen" if i % 3 else None) for i in range(600)] + [(600, ""), (601, "the of")]
    tf = sim.term_frequency(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, tf.collect())) == sorted((i, t, n) for i in range(600) if i % 3 for t, n in (("red", 2), ("fox", 1), ("hen", 1)))
    twice = spark.createDataFrame([("k", "a red fox"), ("k", "red"), (None, "hen"), (None, "hen fox"), ("m", "K x")], "id string, text string")
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, sim.term_frequency(twice, "id", "text").collect()), key=key) == sorted([("k", "red", 2), ("k", "fox", 1), (None, "hen", 2), (None, "fox", 1), ("m", "k", 1), ("m", "x", 1)], key=key)
    assert sorted(map(tuple, sim.relative_frequency(twice.where("id = 'k'"), "id", "text").collect())) == [("k", "fox", 1 / 3), ("k", "red", 2 / 3)]


def test_deals_run_beside_each_other(spark, monkeypatch):
    """deals do not wait for each other, and few rows of features are one partition, so that a step of a fit is one stage."""
    both, fit, parts = threading.Barrier(2, timeout=120), learning.models.train_logistic, []

    def held(rows, features, label):
        parts.append(rows.rdd.getNumPartitions())
        both.wait()
        return fit(rows, features, label)

    monkeypatch.setattr(learning.models, "train_logistic", held)
    rows = spark.createDataFrame([(i, i % 3 == 0, 0.8 if i % 3 == 0 else 0.1 + (i % 11) / 110, (i % 5) / 5) for i in range(200)], "id long, label boolean, candidate_score double, docsim double")
    got = learning.threshold_search(rows.repartition(8), "id", splits=2).collect()
    assert [(r.split, r.f1) for r in got] == [(0, 1.0), (1, 1.0)] and parts == [1, 1]
