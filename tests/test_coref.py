"""Chains by names against hand-made ones."""

from anchorage.operators import coref
from anchorage.plans import system
from anchorage.sources import readers


def test_chains(spark):
    rows = [
        ("d", 0, 0, "PERSON", "Smith"), ("d", 0, 5, "PERSON", "John Smith"), ("d", 1, 0, "PERSON", "Mr John Smith"), ("d", 1, 5, "PERSON", "john"), ("d", 2, 0, "PERSON", "Ann"),
        ("d", 2, 2, "ORGANIZATION", "NYT"), ("d", 2, 4, "ORGANIZATION", "New York Times"), ("d", 3, 0, "LOCATION", "New York"), ("d", 3, 3, "ORGANIZATION", "Times"), ("d", 3, 5, "ORGANIZATION", "nyt"),
        ("f", 0, 0, "PERSON", "Smith"), ("f", 0, 0, "PERSON", "Smith"), ("f", 1, 0, "PERSON", "Smithson Lee"), ("f", 1, 4, "PERSON", ""), ("f", 1, 5, "PERSON", None),
    ]
    df = spark.createDataFrame(rows, "doc_id string, sent int, first int, type string, entity string")
    got = sorted((r.doc_id, r.sent, r.first, r.chain) for r in coref.chains(df).collect())
    assert got == [
        ("d", 0, 0, "mr john smith"), ("d", 0, 5, "mr john smith"), ("d", 1, 0, "mr john smith"), ("d", 1, 5, "mr john smith"), ("d", 2, 0, "ann"), ("d", 2, 2, "new york times"),
        ("d", 2, 4, "new york times"), ("d", 3, 0, "new york"), ("d", 3, 3, "new york times"), ("d", 3, 5, "new york times"), ("f", 0, 0, "smith"), ("f", 0, 0, "smith"), ("f", 1, 0, "smithson lee"),
    ]
    assert coref.chains(df.limit(0)).count() == 0


def test_spans_from_tokens_without_chains(spark, tmp_path):
    """The name at the query's place is a part of the longer one, so both are its spans."""
    base, text = str(tmp_path), "John Smith came . Smith left ."
    spark.createDataFrame([("d1", text)], "doc_id string, text string").write.parquet(f"{base}/documents_2013")
    with open(f"{base}/queries_2013.xml", "w") as f:
        f.write('<kbpentlink><query id="A"><name>Smith</name><docid>d1</docid><beg>18</beg><end>22</end></query></kbpentlink>')
    begin, t = 0, []
    for i, w in enumerate(text.split(" ")):
        t.append(("d1", int(i > 3), i % 4, w, "PERSON" if w in ("John", "Smith") else None, begin, begin + len(w) - 1))
        begin += len(w) + 1
    spark.createDataFrame(t, "doc_id string, sent int, idx int, token string, type string, begin int, end int").write.parquet(f"{base}/tokens_2013")
    system.annotated_files(spark, base, "2013")
    got = readers.coref_spans(spark, f"{base}/spans_2013").first()
    assert got["query_id"] == "A" and [tuple(x) for x in got["spans"]] == [(0, 9), (18, 22)]
