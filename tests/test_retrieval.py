"""Aliases near misspelt strings, links by a saved model, and the saved text model, against brute force and hand-made cases."""

import math
import random

import pytest

from anchorage.__main__ import main
from anchorage.operators import aliases, bayes, candidates
from anchorage.plans import system
from tests.test_system import base  # noqa: F401


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("letters", ["abé", "a", "abcdefgh"])
def test_near_equals_brute_force(spark, letters):
    rnd = random.Random(3)
    some = lambda: ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 13))) for _ in range(150)]
    strings, known = some(), some()
    bound = lambda s: 2 if len(s) >= 9 else 1 if len(s) >= 5 else 0
    want = sorted({(a, b, edits(a, b)) for a in strings for b in known if a and b and edits(a, b) <= bound(a)})
    table = lambda rows: spark.createDataFrame([(x,) for x in [*rows, *rows[:9], None]], "x string")
    assert sorted(map(tuple, aliases.near(table(strings), "x", table(known), "x").collect())) == want
    assert aliases.near(table([]), "x", table(known), "x").count() == aliases.near(table(strings), "x", table([]), "x").count() == 0


def test_retrieved(spark):
    """The best alias of an entity counts; edits lower its score; short strings must be met whole."""
    anchors = spark.createDataFrame([("Gerald Ford", "Ford (president)", 3), ("Gerald Ford", "other", 1), ("Gerald Fort", "Ford (president)", 1), ("Ford", "Ford (company)", 1)], "surface string, kb_name string, n long")
    got = aliases.top_candidates(spark.createDataFrame([("Gerald Fordd",), ("Frd",), ("Ford",)], "s string"), "s", candidates.anchor_priors(anchors), 2)
    rows = {(r.string, r["rank"]): (r.kb_name, r.surface, r.edits, round(r.candidate_score, 6)) for r in got.collect()}
    assert rows == {
        ("Gerald Fordd", 1): ("Ford (president)", "Gerald Fort", 2, round(1 - 2 / 12, 6)), ("Gerald Fordd", 2): ("other", "Gerald Ford", 1, round(0.25 * (1 - 1 / 12), 6)),
        ("Ford", 1): ("Ford (company)", "Ford", 0, 1.0),
    }


def test_text_model(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, ["goal", "goal", "cup"]), (2, 0, ["river", "cup"]), (3, 0, []), (4, None, ["goal"]), (5, 1, None)], "id long, y int, terms array<string>")
    bayes.save(bayes.train(rows, "id", "terms", "y"), f"{tmp_path}/m")
    model = bayes.load(spark, f"{tmp_path}/m")
    assert sorted((r.label, r.term or "", round(r.weight, 6)) for r in model.collect()) == [(0, "", 2), (0, "cup", 0.5), (0, "river", 0.5), (1, "", 2), (1, "cup", 0.333333), (1, "goal", 0.666667)]
    asked = spark.createDataFrame([(1, ["goal", "cup", "cup", "never"]), (2, None), (3, []), (4, ["river"])], "id long, terms array<string>")
    got = {r.id: r for r in bayes.scored(asked, "id", "terms", model).collect()}
    s = bayes.SMOOTHING
    p = lambda w: (w + s) / (1 + 3 * s)
    log = math.log(0.5) + 0.25 * math.log(p(2 / 3)) + 0.5 * math.log(p(1 / 3))
    no = math.log(0.5) + 0.25 * math.log(p(0)) + 0.5 * math.log(p(0.5))
    assert got[1].text_log == pytest.approx(log) and got[1].text_score == pytest.approx(math.exp(log) / (math.exp(log) + math.exp(no)))
    assert got[2].text_score == got[3].text_score == pytest.approx(0.5) and got[4].text_score < 0.5
    for most in (0, 1, 2):  # some or all terms are shuffled to their odds
        again = {r.id: r for r in bayes.scored(asked, "id", "terms", model, most=most).collect()}
        assert all(again[i].text_log == pytest.approx(got[i].text_log) and again[i].text_score == pytest.approx(got[i].text_score) for i in got) and len(again) == 4
    empty = {r.id: r.text_score for r in bayes.scored(asked, "id", "terms", model.limit(0)).collect()}
    assert set(empty.values()) == {0.5} and len(empty) == 4


def test_linker_takes_the_kept_models(spark, base):  # noqa: F811
    """A misspelt name is linked by the model; without it nothing is."""
    spark.createDataFrame([("d1", "Geralt Ford met Ann Lee."), ("d3", "Paris won the match in the cup.")], "doc_id string, text string").write.parquet(f"{base}/documents_2013")
    with open(f"{base}/queries_2013.xml", "w") as f:
        f.write('<kbpentlink><query id="A"><name>Geralt Ford</name><docid>d1</docid></query><query id="B"><name>Paris</name><docid>d3</docid></query></kbpentlink>')
    with open(f"{base}/entities_2013", "w") as f:
        f.write("A\tPERSON\n\tORGANIZATION\n\tLOCATION\n\tPERSON\n" + "B\tLOCATION\tParis\n\tORGANIZATION\n\tLOCATION\tParis\n\tPERSON\n")
    plain = {r.query_id: r.kb_link for r in system.link(spark, base, "2013").collect()}
    with open(f"{base}/link_2013.model", "w") as f:
        f.write("candidate_score\t8.0\ndocsim\t1.0\nIntercept\t-3.0\n")
    by_model = {r.query_id: r.kb_link for r in system.link(spark, base, "2013").collect()}
    assert plain["A"].startswith("NIL") and by_model["A"] == "E1" and plain["B"] == by_model["B"] == "E2"
    before = {r.query_id: r.sports for r in system.expanded_mentions(spark, base, "2013", sports=True).collect()}
    main(["sports-text", "--base-dir", base, "--year", "2013"], spark)
    after = {r.query_id: r.sports for r in system.expanded_mentions(spark, base, "2013", sports=True).collect()}
    assert bayes.load(spark, f"{base}/sports_text").where("term = 'match' and label = 1").count() == 1
    assert before["A"] is None and after["A"] is None and before["B"] is not None and after["B"] is not None
