"""Annotations, stems, training data and models, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from anchorage.functions import stems
from anchorage.operators import annotations as an
from anchorage.plans import learning, models
from anchorage.sources import readers


def test_porter_and_lemma():
    pairs = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
             "relational": "relat", "vietnamization": "vietnam", "hopefulness": "hope", "triplicate": "triplic", "adoption": "adopt", "effective": "effect", "controll": "control", "is": "is"}
    assert {w: stems.porter(w) for w in pairs} == pairs
    assert [stems.lemma(w) for w in ("running", "cities", "played", "making", "stopped", "boxes", "people", "bus")] == ["run", "city", "play", "make", "stop", "box", "person", "bus"]


def test_context_counts(spark):
    r = spark.range(1).select(stems.context_counter(F.lit("The ponies agreed, agreed. Ponies 12 x9")).alias("c"), stems.term_vector(F.lit("Ponies were, the ponies!")).alias("v"), stems.context_counter(F.lit(None).cast("string")).alias("n")).first()
    assert r.c == {"poni": pytest.approx(1 / 3), "agre": pytest.approx(2 / 3)} and r.v == {"Ponies": 1, "ponies": 1} and r.n is None


def test_merged_entities(spark):
    words = [("Baton", "LOCATION"), ("Rouge", "LOCATION"), (",", "O"), ("Louisiana", "LOCATION"), ("Ann", "PERSON"), ("in", "O"), ("Paris", "LOCATION"), ("in", "O"), ("May", None), ("in", None)]
    rows = [(1, 0, i, w, t) for i, (w, t) in enumerate(words)] + [(1, 1, 0, "Texas", "LOCATION"), (2, 0, 0, "no", None)]
    got = an.merged_entities(spark.createDataFrame(rows, "doc_id long, sent int, idx int, token string, type string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 3, "LOCATION", "Baton Rouge , Louisiana"), (1, 0, 4, 4, "PERSON", "Ann"), (1, 0, 6, 6, "LOCATION", "Paris"), (1, 1, 0, 0, "LOCATION", "Texas")]
    lists = an.entities_by_type(got).first()
    assert lists.locs == ["Baton Rouge , Louisiana", "Paris", "Texas"] and lists.people == ["Ann"] and lists.orgs == []


def test_years():
    assert learning.training_years("2013") == ("2011", "2012") and learning.checked_year(2010) == "2010"
    for f, y in ((learning.checked_year, "2014"), (learning.training_years, "2010")):
        with pytest.raises(ValueError):
            f(y)


def test_link_model(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0, 0.8 + (i % 7) / 70 if i % 3 == 0 else 0.1 + (i % 11) / 110, (i % 5) / 5, "2011" if i % 2 else "2012") for i in range(400)], "id long, label boolean, candidate_score double, docsim double, year string")
    w, b = learning.train_links(rows)
    scored = learning.scored_by(rows, w, b)
    assert scored.where((F.col("score") > 0.5) != F.col("label")).count() == 0
    found = learning.threshold_search(rows, "id", splits=3).collect()
    assert len(found) == 3 and all(r.f1 == 1 for r in found)
    lines = [r.line.split("\t") for r in learning.cross_year(rows, "2012", "2011", "id").orderBy("rank").collect()]
    assert len(lines) == 200 and lines[0][:2] == ["1.00", "0.00"] and float(lines[0][2]) > float(lines[-1][2])


def test_training_rows(spark):
    training = spark.createDataFrame([(True, "q1", "Ford", "E1"), (False, "q2", "Ford", "E9"), (True, "q3", "Ann", "E2")], "label boolean, query_id string, used string, expected string")
    queries = spark.createDataFrame([("q1", "x"), ("q2", "y")], "query_id string, entity string")
    cands = spark.createDataFrame([("Ford", "E1", 0.7), ("Ann", "E2", 0.9)], "surface string, kb_name string, candidate_score double")
    assert [(r.query_id, r.label, r.entity, r.candidate_score) for r in learning.labelled_candidates(training, queries, cands).collect()] == [("q1", True, "Ford", 0.7)]


def test_sports_evaluation_both_ways(spark):
    rows = spark.createDataFrame([(i, i % 2 == 0, "match goal team" if i % 2 == 0 else "city river town", float(i % 2 == 0)) for i in range(300)], "id long, label boolean, text string, x double")
    down = [r.line for r in learning.sports_evaluation(rows, "id", ["x"]).orderBy("rank").collect()]
    up = [r.line for r in learning.sports_evaluation(rows, "id", ["x"], ascending=True).orderBy("rank").collect()]
    assert down[0].startswith("1.00") and float(up[0].split("\t")[0]) < 0.7 and len(down) == len(up)


def test_sports_model_file(spark, tmp_path):
    """A model file with the features' own names is taken by column; an unknown name is an error."""
    lines = [f"{n}\t{models.SPORTS_WEIGHTS[c]!r}" for n, c in models.SPORTS_NAMES.items()] + ["Intercept\t-0.0"]
    (tmp_path / "m.model").write_text("\n".join(lines))
    weights, intercept = readers.linear_model(spark, str(tmp_path / "m.model"))
    assert models.by_column(weights) == models.SPORTS_WEIGHTS and intercept == 0
    with pytest.raises(ValueError):
        models.by_column({"no such feature": 1.0})


def test_corpus_by_year(spark):
    q = spark.createDataFrame([("1", "d1", "2012"), ("2", "d1", "2013"), ("3", "d9", "2013")], "query_id string, doc_id string, year string")
    docs = lambda t: spark.createDataFrame([("d1", t)], "doc_id string, text string")
    got = {r.query_id: r.text for r in readers.corpus_documents(q, {"2012": docs("old"), "2013": docs("new")}).collect()}
    assert got == {"1": "old", "2": "new", "3": ""}
    with pytest.raises(ValueError):
        readers.corpus_documents(q, {"2012": docs("old")})


def test_entity_joins(spark):
    q = spark.createDataFrame([("1", "d"), ("2", "d")], "query_id string, doc_id string")
    s = spark.createDataFrame([("1", [(0, 3)])], "query_id string, spans array<struct<start:int,end:int>>")
    assert {r.query_id: len(r.spans) for r in an.with_spans(q, s).collect()} == {"1": 1, "2": 0} and an.with_spans(q, s, strict=True).count() == 1
    e = spark.createDataFrame([("1", "PERSON", ["a"], ["b"], ["c"], ["d"])], "query_id string, ner_type string, matching array<string>, orgs array<string>, locs array<string>, people array<string>")
    assert {r.query_id: r.error_reason for r in an.with_entities(q, e).collect()} == {"1": None, "2": "no annotation"}
    places = spark.createDataFrame([("paris",)], "name_lc string")
    o = spark.createDataFrame([(1, ["Bank of Paris", "Acme", "Paris Club"]), (2, ["Acme"]), (3, []), (4, None)], "id int, orgs array<string>")
    assert {r.id: r.ratio for r in an.organizations_with_locations(o, "id", "orgs", places).collect()} == {1: 1.5, 2: 1.0, 3: 0.0, 4: 10.0}
    full = lambda c, n, locs: spark.range(1).select(an.fully_specified_location(F.lit(c), F.lit(n), F.array(*map(F.lit, locs))).alias("x")).first().x
    assert full("He came to Paris from texas.", "Paris", ["Paris, Texas"]) and not full("He came to Paris.", "Paris", ["Paris, Texas"]) and not full("in Texas", "Rome", ["Paris, Texas"])
