"""Goldens worked out by hand, and properties of the operators."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from anchorage.functions import similarity as sim
from anchorage.functions import text as tx
from anchorage.operators import candidates, evaluate, gazetteer, linking, nil, surface
from anchorage.plans import models
from anchorage.sources import readers, writers
from anchorage.streaming.linker import stream_links


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def pair(spark, rows):
    mk = lambda k: spark.createDataFrame([(r[0], r[k]) for r in rows], "query_id string, kb_link string")
    return mk(1), mk(2)


GOLD = [("q1", "E1", "E1"), ("q2", "E1", "E2"), ("q3", "NIL0000", "NIL9"), ("q4", "NIL0001", "NIL9")]


def test_evaluation(spark):
    s, g = pair(spark, GOLD)
    r = evaluate.b_cubed(s, g).first()
    assert (r.precision, r.recall) == (0.625, 0.5) and r.f1 == pytest.approx(0.5556, abs=1e-4)
    assert {x.query_id: x.outcome for x in evaluate.outcomes(s, g).collect()} == {"q1": "CORRECT", "q2": "WRONG KB ID", "q3": "WRONG NIL ID", "q4": "WRONG NIL ID"}
    assert evaluate.over_clustered(s, g).first().over_clustered == 1 and evaluate.missing(s, g).count() == 0
    assert {r.line for r in evaluate.report(s, g).collect()} >= {"WRONG KB ID\tq2\tE1\tEXPECTED E2"}


@pytest.mark.parametrize("seed", range(3))
def test_b_cubed_is_the_pairwise_one(spark, seed):
    rng = random.Random(seed)
    rows = [(str(i), rng.choice(["E1", "E2", "NIL1", "NIL2"]), rng.choice(["E1", "E3", "NIL1", "NIL2"])) for i in range(60)]
    by_s, by_g = defaultdict(list), defaultdict(list)
    for r in rows:
        by_s[r[1]].append(r)
        by_g[r[2]].append(r)
    right = lambda a, b: a[1] == b[1] and a[2] == b[2] and (a[1] == a[2] if a[2][0] == "E" else a[1][0] == "N")
    p = sum(sum(right(a, b) for b in by_s[a[1]]) / len(by_s[a[1]]) for a in rows) / len(rows)
    q = sum(sum(right(a, b) for b in by_g[a[2]]) / len(by_g[a[2]]) for a in rows) / len(rows)
    r = evaluate.b_cubed(*pair(spark, rows)).first()
    assert (r.precision, r.recall) == (pytest.approx(p), pytest.approx(q))


def test_text(spark):
    L = F.lit
    assert one(spark, tx.backoff_strings(L("Ford"), L("UTC Graham Ford"))) == ["Graham Ford", "UTC Graham Ford"]
    assert one(spark, tx.location_casing(L("NEW york, U.S."))) == "New York, U.S."
    assert [one(spark, tx.word_count(L(s))) for s in ("a b  ", "", " ", "a  b")] == [2, 1, 0, 3]
    doc = "<HEADLINE>\nA-B  wins\n</HEADLINE> x <P>\nFirst  para.\n</P>"
    assert one(spark, tx.headline_contexts(L(doc))) == ["First para.", "A B wins"]
    conf = {0.93: 0.55, 0.9301: 0.80, 0.94: 0.8286, 0.96: 0.8857, 0.99: 0.9714, 1.0: 1.0}
    for s, c in conf.items():
        assert one(spark, tx.confidence(L(s))) == pytest.approx(c, abs=5e-5)
    assert one(spark, tx.occurrences(L("aaaa"), L("aa"))) == [0, 1, 2] and one(spark, tx.occurrences(L("b"), L("aa"))) == []
    assert one(spark, tx.occurrences(L("ab.ab"), L("ab"))) == [0, 3] and one(spark, tx.occurrences(L("é\U0001f600a\\E.a\\E"), L("a\\E"))) == [2, 6]
    assert one(spark, tx.occurrences(L("ab"), L(""))) == [0, 1, 2] and one(spark, tx.occurrences(L(""), L("a"))) == []
    assert one(spark, tx.location_casing(L("nEW  \u00dfkeit \u00c9TAT U.S. "))) == "New  \u00dfkeit \u00c9tat U.S. "
    text = "<P>One here. Two Ford there. Three.</P> tail"
    assert one(spark, tx.context(L(text), L("Ford"), L(-1))) == "Two Ford there."
    assert one(spark, tx.abbreviation(L("united nations org"))) == "UNO" and one(spark, tx.without_parentheses(L("Ford (car)"))) == "Ford"
    assert one(spark, tx.mention_contexts(F.array(L("a b"), L("a b")), F.array(L("b"), L("c")))) == ["c", "a b"]
    assert one(spark, tx.first_paragraphs(L("x\n\na b c d e f g h\n\nshort"))) == "a b c d e f g h"
    assert one(spark, tx.intro(L("First one. Then two."))) == "First one." and len(one(spark, tx.intro(L("x" * 300)))) == 100


def test_nil(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pos long, q string").withColumn("consumed", F.when(F.col("pos") == 2, 2).otherwise(1))
    for width in (1, 2, 1 << 20):
        assert [r.nil_id for r in nil.allocate(df, width=width).orderBy("pos").collect()] == ["NIL0000", "NIL0002", "NIL0003"]
    rows = [(0, "0", "Ford", "Gerald Ford", "NIL0000", 0.55), (1, "1", "Gerald Ford", "Gerald Ford", "NIL0001", 0.55), (2, "2", "X", "X", "NIL0002", 0.55), (3, "3", "Y", "Y", "E5", 0.8)]
    got = nil.cluster_exact(spark.createDataFrame(rows, "pos long, query_id string, name string, entity string, kb_link string, confidence double")).orderBy("pos").collect()
    assert [(r.kb_link, r.confidence) for r in got] == [("NIL0000", 0.6), ("NIL0000", 0.6), ("NIL0002", 0.55), ("E5", 0.8)]


@pytest.mark.parametrize("seed", range(2))
def test_average_link_by_components(spark, seed):
    rng = random.Random(seed)
    ids = [f"{'E' if i % 5 == 0 else 'NIL'}{i:04d}" for i in range(24)]
    pairs = {(a, b): rng.random() ** 3 for i, a in enumerate(ids) for b in ids[i + 1 :]}
    whole = nil.agglomerate(ids, {k: (v, 1) for k, v in pairs.items()}, 0.7)
    links = spark.createDataFrame([(i, i) for i in ids], "query_id string, kb_link string")
    got = nil.cluster_average_link(links, spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a string, b string, sim double"), 0.7)
    assert {r.query_id: r.kb_link for r in got.collect()} == whole
    # The same in rounds over the table, and by the plain rule: the best pair of all, again and again.
    scores = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a string, b string, sim double")
    assert {r.query_id: r.kb_link for r in nil.cluster_average_link(links, scores, 0.7, task_pairs=0).collect()} == whole
    clusters = {i: [i] for i in ids}
    while True:
        mean = lambda x, y: sum(pairs.get((a, b), pairs.get((b, a))) for a in clusters[x] for b in clusters[y]) / len(clusters[x]) / len(clusters[y])
        best = max(((mean(x, y), x, y) for x in clusters for y in clusters if x < y and (x[0] == "N" or y[0] == "N")), default=(0, "", ""))
        if best[0] < 0.7:
            break
        keep, lose = (best[2], best[1]) if best[2][0] == "E" else best[1:]
        clusters[keep] += clusters.pop(lose)
    assert {i: k for k, own in clusters.items() for i in own} == whole


def test_link_cascade(spark):
    m = [(0, "q0", "Ford", "Gerald Ford", None, None), (1, "q1", "Paris", "Paris", True, None), (2, "q2", "Ann", "Big Town Ann Lee", None, None), (3, "q3", "Z", "Z", None, "no annotation"), (4, "q4", "W", "Gone", None, None), (5, "q5", "Ti", "Exact Title", None, None)]
    c = [("q0", "Gerald Ford", "Gerald Ford", 0.99, 1), ("q1", "Paris", "Paris", 0.98, 1), ("q1", "Paris", "Paris FC", 0.95, 2), ("q2", "Ann Lee", "Ann Lee", 0.2, 1), ("q4", "Gone", "Gone (film)", 0.97, 1)]
    kb = [("E1", "Gerald Ford", "person", "PER", 1), ("E2", "Paris", "city", "GPE", 2), ("E3", "Paris FC", "football club", "ORG", 3), ("E4", "Ann Lee", "", "", 4), ("E5", "Exact Title", "", "", 5)]
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    args = (mk(m, "pos long, query_id string, name string, entity string, sports boolean, error_reason string"), mk(c, "query_id string, surface string, kb_name string, score double, rank int"), mk(kb, "kb_id string, title string, wiki_type string, structured_type string, line_no long"))
    got = {r.query_id: r for r in linking.link(*args).collect()}
    assert {k: r.kb_link for k, r in got.items()} == {"q0": "E1", "q1": "E3", "q2": "E4", "q3": "NIL0000", "q4": "NIL0001", "q5": "E5"}
    assert [got[f"q{i}"].confidence for i in (1, 2, 3, 5)] == [0.7, 0.55, 0.1, 0.8] and got["q4"].entity == "Gone" and got["q2"].entity == "Ann Lee"
    assert {r.query_id: r.kb_link for r in linking.link(*args, nil_parity=True).collect()}["q4"] == "NIL0002"


def test_surface():
    gaz = surface.Gazetteer(frozenset({"baton rouge", "paris"}), frozenset({"louisiana", "texas"}), frozenset({"france"}), {"Louisiana": frozenset({"Baton Rouge"}), "France": frozenset({"Paris"}), "Texas": frozenset({"Paris"})})
    M = surface.Mention
    assert surface.best_string(M("UN", "The United Nations (UN) met.", 20, "ORGANIZATION", orgs=["United Nations"]), gaz) == "United Nations"
    assert surface.best_string(M("Ford", "Gerald Ford spoke. Ford left.", 19, "PERSON", people=["Gerald Ford"]), gaz) == "Gerald Ford"
    assert surface.best_string(M("Paris", "in Paris. France and Paris", 21, "LOCATION", locs=["France", "Paris"]), gaz) == "Paris, France"
    assert surface.best_string(M("Paris", "He saw Paris, Texas.", 7, "LOCATION"), gaz) == "Paris, Texas"
    assert surface._expanded("Baton Rouge, La.", gaz) == "Baton Rouge, La."
    assert surface.best_string(M("Acme", "Acme Holdings grew. It is Acme.", 26, "None", matching=["The Acme Group"], spans=[(0, 12)]), gaz) == "Acme"
    with pytest.raises(ValueError):
        surface.best_string(M("x", "x", 0, "DATE"), gaz)


def test_gazetteer(spark):
    assert one(spark, gazetteer.expand_state(F.lit("Austin, Tx."))) == "Austin, Texas" and one(spark, gazetteer.expand_state(F.lit("Austin"))) == "Austin"
    rows = spark.createDataFrame([("Mass.",), ("Te",)], "t string")
    states = spark.createDataFrame([(s,) for s in gazetteer.STATES.values()], "state string")
    assert {r.t: r.expanded for r in gazetteer.expand_prefix(rows, "t", states).collect()} == {"Mass.": "Massachusetts", "Te": None}


def test_similarity(spark):
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,int>")
    assert one(spark, sim.map_cosine(m({"a": 1, "b": 2}), m({"b": 3}))) == pytest.approx(0.894427, abs=1e-6) and one(spark, sim.map_cosine(m({}), m({"b": 3}))) == 0
    assert sim.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and sim.jaro_winkler_of("", "a") == 0
    side = F.struct(F.lit("Ford").alias("name"), F.lit("Gerald Ford").alias("entity"), *[m({"a": 1}).alias(k) for k in ("context", "wide", "coref", "links", "args")])
    r = sim.pair_features(spark.range(1).select(side.alias("a"), side.alias("b")), ["ford"]).first()
    assert (r.common_surname, r.link_similarity, r.alternate_similarity) == (1.0, pytest.approx(1.0), 1.0)


def test_models(spark):
    rows = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(zip([0.9, 0.8, 0.7, 0.6], [1, 0, 1, 0], strict=True))], "id long, s double, y int")
    for bins in (1, 3, 1000):
        got = [r.interpolated for r in models.interpolated_precision(rows, "y", "s", "id", bins=bins).orderBy("rank").collect()]
        assert got == pytest.approx([1, 2 / 3, 2 / 3, 0.5])
        assert [r.interpolated for r in models.interpolated_precision(rows, "y", "s", "id", True, bins).orderBy("rank").collect()] == pytest.approx([1, 2 / 3])
    assert models.best_threshold(rows, "y", "s", "id").first().threshold == 0.7
    train = spark.createDataFrame([(i % 2, float(i % 2) + (i % 7) / 10) for i in range(80)], "label int, x double")
    w, b = models.train_logistic(train, ["x"])
    assert w["x"] > 0
    p = train.withColumn("p", candidates.logistic(w, {"x": F.col("x")}, b)).agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("int"))).first()[0]
    assert p > 0.9


def test_files(spark, tmp_path):
    p = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    x = p("q.xml", '<kbpentlink><query id="A1"><name>Ford</name><docid>d1</docid><beg>3</beg><end>6</end></query><query id="A2"><name>UN</name><docid>d2</docid></query></kbpentlink>')
    assert [(r.query_id, r.beg, r.end) for r in readers.queries_xml(spark, x).orderBy("pos").collect()] == [("A1", 3, 6), ("A2", -1, -1)]
    gold = readers.answers_tsv(spark, p("g.tab", "A1\tE1\tPER\tNW\tYES\nA2\tNIL1\n"))
    assert [(r.query_id, r.kb_link, r.genre) for r in gold.collect()] == [("A1", "E1", "NW"), ("A2", "NIL1", None)]
    names = readers.kb_map(spark, p("w.txt", "E1\tFord\tPER\nE2\tFord\tORG\nbad\n"), ("kb_id", "title", "entity_type"), "title", exact=False)
    assert [(r.title, r.kb_id) for r in names.collect()] == [("Ford", "E2")]
    spans = readers.coref_spans(spark, p("c.txt", "A1\t[3, 6]\t[10, 12]\nA2\n")).collect()
    assert [[tuple(s) for s in r.spans] for r in spans] == [[(3, 6), (10, 12)], []]
    ne = readers.named_entities(spark, p("n.txt", "A1\tPERSON\tGerald Ford\n\tORGANIZATION\tUN\n\tLOCATION\n\tPERSON\tGerald Ford\tAnn\nA2\n\tORGANIZATION\n\tLOCATION\tParis\n\tPERSON\n"))
    by = {r.query_id: r for r in ne.collect()}
    assert by["A1"].people == ["Gerald Ford", "Ann"] and by["A2"].ner_type == "None" and by["A2"].locs == ["Paris"]
    assert writers.entity_lines(ne.where("query_id = 'A1'")).first().value.split("\n")[1] == "\tORGANIZATION\tUN"
    places, city_in = readers.gazetteer(spark, p("t.txt", "Paris (CITY 1) Texas (PROVINCE 2) United States (COUNTRY)\n"))
    assert {(r.name_lc, r.kind) for r in places.collect()} == {("paris", "city"), ("texas", "state"), ("united states", "country")}
    assert {(r.container, r.city) for r in city_in.collect()} == {("Texas", "Paris"), ("United States", "Paris")}
    assert readers.linear_model(spark, p("m.model", "a\t1.5\nIntercept\t-0.5\n")) == ({"a": 1.5}, -0.5)
    assert {r.word for r in readers.word_list(spark, p("s.txt", "A,b , c")).collect()} == {"a", "b", "c"}
    assert readers.link_training(spark, p("l.csv", "CORRECT\tA1\tFord\tFord\nx\n")).count() == 1
    assert readers.benchmark_report(spark, p("b.tsv", "\t".join(map(str, range(11))) + "\nshort\n")).first().kb_title == "9"
    kb = readers.kb_xml(spark, p("kb.xml", '<kb><entity wiki_title="F" type="PER" id="E1" name="Ford"><facts class="Infobox"></facts><wiki_text><![CDATA[Ford\n\nText.]]></wiki_text></entity></kb>')).first()
    assert (kb.kb_id, kb.title, kb.wiki_type, kb.text) == ("E1", "Ford", "Infobox", "Ford\n\nText.")
    docs = spark.createDataFrame([("d1", "text"), ("d3", "a"), ("d3", "b")], "doc_id string, text string")
    q = spark.createDataFrame([("1", "d1"), ("2", "d2"), ("3", "d3")], "query_id string, doc_id string")
    assert {r.query_id: r.text for r in readers.with_documents(q, docs).collect()} == {"1": "text", "2": "", "3": ""}
    a = spark.createDataFrame([(0, "A1", "E1", 0.8)], "pos long, query_id string, kb_link string, confidence double")
    assert writers.submission(a).first().value == "A1\tE1\t0.80"
    made = writers.ensure(spark, str(tmp_path / "t"), lambda: a)
    assert made.count() == 1 and writers.ensure(spark, str(tmp_path / "t"), lambda: 1 / 0).count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, "Q1"), (1, "Q2")], "pos long, query_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pos long, query_id string").parquet(str(tmp_path / "in"))
    q = stream_links(stream, lambda b: nil.allocate(b.withColumn("consumed", F.lit(1))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r.nil_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"NIL0000", "NIL0001"}


def test_passage_links(spark):
    docs = spark.createDataFrame([(1, "say one two three four five six now"), (1, "nothing"), (2, "one two three four five"), (3, None), (4, "catalog"), (5, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "cat"), (3, ""), (4, None), (5, "two three four five s")], "item_id long, text string")
    got = sorted(map(tuple, linking.passage_links(docs, items).collect()))
    assert got == [(1, 1), (1, 5), (4, 2), (5, 1), (5, 5)]
    assert linking.passage_links(docs, items.limit(0)).count() == 0


def test_average_link_compares_every_pair_of_a_label(spark, tmp_path):
    import anchorage.plans.queries  # noqa: F401
    from anchorage.plans.registry import QUERIES

    rng = random.Random(4)
    rows = []
    for i in range(40):
        centre = [rng.gauss(0, 1) for _ in range(8)] if i % 4 == 0 else centre
        rows.append((i, f"l{i // 20}", [c + rng.gauss(0, 0.2) for c in centre]))
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cos = {(a, b): sum(x * y for x, y in zip(u, v, strict=True)) / norm(u) / norm(v) for a, k, u in rows for b, m, v in rows if a < b and k == m}
    name = lambda i: f"NIL{i:08d}"
    want = nil.agglomerate([name(i) for i, *_ in rows], {(name(a), name(b)): (s, 1) for (a, b), s in cos.items()}, 0.5)
    got = {name(int(r.query_id)): r.kb_link for r in QUERIES["average_link_clusters"](spark, str(tmp_path)).collect()}
    assert got == want and len(set(got.values())) < len(got)
