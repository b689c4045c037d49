"""The linker, its evaluation and the other tools, from hand-made files to files."""

import pytest

from anchorage.__main__ import main
from anchorage.plans import models, system

DOCS = [
    ("d1", "Gerald Ford met Ann Lee. Ford left for Paris, Texas."),
    ("d2", "Acme Holdings grew. It is Acme that won."),
    ("d3", "Paris won the match in the cup."),
    ("d4", "Nobody knows Zed here."),
]
QUERIES = [("Q1", "Ford", "d1"), ("Q2", "Acme", "d2"), ("Q3", "Paris", "d3"), ("Q4", "Zed", "d4"), ("Q5", "Zed", "d4")]
ENTITIES = {"Q1": ("PERSON", ["Gerald Ford", "Ann Lee"], [], ["Paris, Texas"], ["Gerald Ford", "Ann Lee"]), "Q2": ("ORGANIZATION", ["Acme Holdings"], ["Acme Holdings"], [], []), "Q3": ("LOCATION", ["Paris"], [], ["Paris"], []), "Q5": ("PERSON", ["Zed"], [], [], ["Zed Young"])}


@pytest.fixture()
def base(spark, tmp_path):
    for year in ("2011", "2012"):
        (tmp_path / f"queries_{year}.xml").write_text("<kbpentlink>" + "".join(f'<query id="{q}"><name>{n}</name><docid>{d}</docid></query>' for q, n, d in QUERIES) + "</kbpentlink>")
        (tmp_path / f"answers_{year}.tab").write_text("Q1\tE1\tPER\nQ2\tNIL1\tORG\nQ3\tE3\tORG\nQ4\tNIL2\tPER\nQ5\tNIL3\tPER\n")
        lines = []
        for q, (kind, matching, orgs, locs, people) in ENTITIES.items():
            lines += ["\t".join([q, kind, *matching]), "\t".join(["", "ORGANIZATION", *orgs]), "\t".join(["", "LOCATION", *locs]), "\t".join(["", "PERSON", *people])]
        (tmp_path / f"entities_{year}").write_text("\n".join(lines) + "\n")
        spark.createDataFrame(DOCS, "doc_id string, text string").write.parquet(f"{tmp_path}/documents_{year}")
        (tmp_path / f"training_{year}.csv").write_text("".join(f"{'CORRECT' if i % 2 else 'WRONG'}\t{QUERIES[i % 5][0]}\tString {i}\t{'Right' if i % 2 else 'Wrong'} {i}\n" for i in range(120)))
    (tmp_path / "kb").mkdir()
    kb = [("E1", "Gerald Ford", "person", "PER"), ("E2", "Paris", "City", "GPE"), ("E3", "Paris FC", "football club", "ORG")]
    for name, rows in (("title", [(k, t) for k, t, _, _ in kb]), ("intro", [(k, f"{t} is known.") for k, t, _, _ in kb]), ("wiki_type", [(k, w) for k, _, w, _ in kb]), ("structured_type", [(s, k) for k, _, _, s in kb])):
        (tmp_path / "kb" / name).write_text("".join("\t".join(r) + "\n" for r in rows))
    anchors = [("Gerald Ford", "Gerald Ford", 99), ("Gerald Ford", "Paris", 1), ("Paris", "Paris", 970), ("Paris", "Paris FC", 30), ("Acme Holdings", "Acme Holdings (company)", 10)]
    anchors += [(f"String {i}", f"{'Right' if i % 2 else 'Wrong'} {i}", 90 - i % 9 if i % 2 else 10 + i % 9) for i in range(120)] + [(f"String {i}", "other", 10 if i % 2 else 90) for i in range(120)]
    spark.createDataFrame(anchors, "surface string, kb_name string, n long").write.parquet(f"{tmp_path}/anchors")
    (tmp_path / "gazetteer.txt").write_text("Paris (CITY 1) Texas (PROVINCE 2)\nParis (CITY 1) France (COUNTRY)\n")
    (tmp_path / "sports.model").write_text("".join(f"{n}\t{models.SPORTS_WEIGHTS[c]!r}\n" for n, c in models.SPORTS_NAMES.items()) + "Intercept\t-0.0\n")
    return str(tmp_path)


def read(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_linker_and_benchmark(spark, base, capsys):
    got = {r.query_id: r for r in system.link(spark, base, "2012").collect()}
    assert {k: r.kb_link for k, r in got.items()} == {"Q1": "E1", "Q2": "NIL0000", "Q3": "E2", "Q4": "NIL0001", "Q5": "NIL0002"}
    assert got["Q1"].entity == "Gerald Ford" and got["Q2"].entity == "Acme Holdings" and got["Q4"].confidence == 0.1 and got["Q5"].entity == "Zed Young"
    main(["link", "--base-dir", base, "--output", f"{base}/out"], spark)
    assert [x.split("\t")[:2] for x in read(spark, f"{base}/out")][:2] == [["Q1", "E1"], ["Q2", "NIL0000"]]
    main(["benchmark", "--base-dir", base, "--answers", f"{base}/out", "--output", f"{base}/report"], spark)
    shown = dict(x.split("\t") for x in capsys.readouterr().out.strip().splitlines())
    assert (float(shown["CORRECT"]), float(shown["WRONG KB ID"]), float(shown["NIL OK"])) == (1, 1, 3)
    assert "WRONG KB ID\tQ3\tE2\tEXPECTED E3" in read(spark, f"{base}/report")
    main(["benchmark", "--base-dir", base, "--sort", "query"], spark)
    assert dict(x.split("\t") for x in capsys.readouterr().out.strip().splitlines()) == shown


def test_each_stage_is_made_once(spark, base):
    relations = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert relations(system.link(spark, base, "2012")) == 1
    names = system.expanded_mentions(spark, base, "2012", sports=True)._jdf.queryExecution().optimizedPlan().toString()
    assert names.count("Relation [doc_id") == 1


def test_sports_sense_moves_a_place_to_its_team(spark, base):
    got = {r.query_id: r for r in system.link(spark, base, "2012", sports=True).collect()}
    assert (got["Q3"].kb_link[:3], got["Q3"].confidence) == ("NIL", 0.5)  # the team's share of the anchors is below the threshold
    assert got["Q1"].kb_link == "E1"


def test_human_readable(spark, base):
    main(["link", "--base-dir", base, "--output", f"{base}/shown", "--human-readable"], spark)
    first = read(spark, f"{base}/shown")[0].split("\t")
    assert first[:4] == ["Q1", "Ford", "Gerald Ford", "d1"] and first[5:] == ["E1", "Gerald Ford", "Gerald Ford is known."]


def test_annotations_from_scratch(spark, base):
    words, rows = [("Gerald", "PERSON"), ("Ford", "PERSON"), ("met", "O"), ("Acme", "ORGANIZATION"), (".", "O")], []
    at = 0
    for i, (w, t) in enumerate(words):
        rows.append(("d1", 0, i, w, t, at, at + len(w), "c1" if i < 2 else None))
        at += len(w) + 1
    spark.createDataFrame(rows, "doc_id string, sent int, idx int, token string, type string, begin int, end int, chain string").write.parquet(f"{base}/tokens_2013")
    with open(f"{base}/queries_2013.xml", "w") as f:
        f.write('<kbpentlink><query id="A"><name>Gerald Ford</name><docid>d1</docid><beg>0</beg><end>11</end></query><query id="B"><name>x</name><docid>d2</docid></query></kbpentlink>')
    spark.createDataFrame([("d1", "Gerald Ford met Acme ."), ("d2", "none")], "doc_id string, text string").write.parquet(f"{base}/documents_2013")
    main(["annotate", "--base-dir", base, "--year", "2013"], spark)
    main(["annotate", "--base-dir", base, "--year", "2013"], spark)  # what is there stays
    lines = spark.read.text(f"{base}/entities_2013").collect()
    assert {"A\tPERSON\tGerald Ford", "\tORGANIZATION\tAcme", "\tPERSON\tGerald Ford", "B\t"} <= {r.value for r in lines}
    assert read(spark, f"{base}/spans_2013") == ["A\t[0, 11]"]
    main(["mentions", "--base-dir", base, "--year", "2013", "--output", f"{base}/m"], spark)
    main(["representatives", "--base-dir", base, "--year", "2013", "--output", f"{base}/r"], spark)
    assert read(spark, f"{base}/m") == read(spark, f"{base}/r") == ["A\tGerald Ford"]
    assert {r.query_id: r.kb_link for r in system.link(spark, base, "2013", from_scratch=True).collect()}["A"] == "E1"


def test_training_tools(spark, base, capsys):
    main(["link-model", "--base-dir", base, "--year", "2013", "--output", f"{base}/model"], spark)
    weights = dict(x.split("\t") for x in read(spark, f"{base}/model"))
    assert set(weights) == {"candidate_score", "docsim", "Intercept"} and float(weights["candidate_score"]) > 0
    main(["link-precision", "--base-dir", base, "--output", f"{base}/p"], spark)
    assert len(read(spark, f"{base}/p")) == 120
    main(["augment-training", "--base-dir", base, "--output", f"{base}/a"], spark)
    assert read(spark, f"{base}/a")[0].split("\t")[-1] == "0"
    main(["types", "--base-dir", base, "--output", f"{base}/t"], spark)
    assert read(spark, f"{base}/t")[0] == "Q1\tPERSON\tGerald Ford\tAnn Lee"
    main(["alternates", "--base-dir", base, "--output", f"{base}/n"], spark)
    assert read(spark, f"{base}/n") == ["Q1\td1\tFord\tGerald Ford", "Q2\td2\tAcme\tAcme Holdings", "Q5\td4\tZed\tZed Young"]
    capsys.readouterr()
    main(["gazetteer", "--base-dir", base], spark)
    assert capsys.readouterr().out.splitlines() == ["France\tParis\tcountry", "Texas\tParis\tstate"]
    with pytest.raises(SystemExit):
        main(["link", "--year", "2014"], spark)
