"""Readers of queries, answers, knowledge-base maps, annotations, gazetteers and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _lines(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(line_no, value): line_no grows with the place of a line in its file."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        df = spark.read.text(path)
    else:
        df = spark.read.schema("value string").option("sep", "\x00").option("quote", "").option("encoding", encoding).csv(path)
    return df.select(F.monotonically_increasing_id().alias("line_no"), "value")


def _fields(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    return _lines(spark, path, encoding).select("line_no", F.split("value", "\t", -1).alias("f"))


def _last(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: of several lines the last counts."""
    rest = [c for c in df.columns if c not in (key, "line_no")]
    return df.groupBy(key).agg(F.max_by(F.struct("line_no", *rest), "line_no").alias("r")).select(key, "r.*")


def queries_xml(spark: SparkSession, path: str, year: str = "") -> DataFrame:
    """<query id><name/><docid/><beg/><end/></query> -> (pos, query_id, name, doc_id, beg, end, year); both offsets -1 if either is missing or no number."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("_id", "name", "docid", "beg", "end")])
    x = spark.read.format("xml").option("rowTag", "query").schema(schema).load(path).where("_id is not null and docid is not null")
    beg, end = F.expr("try_cast(beg as int)"), F.expr("try_cast(`end` as int)")
    both = beg.isNotNull() & end.isNotNull()
    return x.select(
        F.monotonically_increasing_id().alias("pos"), F.col("_id").alias("query_id"), "name", F.col("docid").alias("doc_id"),
        F.when(both, beg).otherwise(-1).alias("beg"), F.when(both, end).otherwise(-1).alias("end"), F.lit(year).alias("year"),
    )


def answers_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Gold or submitted answers -> (query_id, kb_link, confidence, entity_type, genre, flag); confidence 0."""
    f = _fields(spark, path)
    opt = lambda i: F.get("f", F.lit(i))
    return f.where(F.size("f") >= 2).select(opt(0).alias("query_id"), opt(1).alias("kb_link"), F.lit(0.0).alias("confidence"), opt(2).alias("entity_type"), opt(3).alias("genre"), opt(4).alias("flag"))


def kb_map(spark: SparkSession, path: str, columns: Sequence[str], key: str, exact: bool = True) -> DataFrame:
    """A knowledge-base map with its columns by place; lines of another number of fields are passed over (exact) or cut; the last line of a key counts.

    wiki names: columns ("kb_id", "title", "entity_type"), exact False; titles ("kb_id", "title"); texts ("kb_id", "intro");
    types ("kb_id", "wiki_type"); structured types ("structured_type", "kb_id").
    """
    f = _fields(spark, path)
    f = f.where(F.size("f") == len(columns) if exact else F.size("f") >= len(columns))
    return _last(f.select("line_no", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)]), key)


def kb_context(spark: SparkSession, path: str) -> DataFrame:
    """(kb_id, context): the context is "" where the line has none."""
    f = _fields(spark, path)
    return _last(f.select("line_no", F.get("f", F.lit(0)).alias("kb_id"), F.coalesce(F.get("f", F.lit(1)), F.lit("")).alias("context")), "kb_id")


def knowledge_base(titles: DataFrame, intros: DataFrame, wiki_types: DataFrame, structured: DataFrame) -> DataFrame:
    """One dimension of entities: (kb_id, title, intro, wiki_type, structured_type, line_no), missing title and intro "None", missing type ""."""
    t = titles.select("kb_id", "title", "line_no")
    for other, c in ((intros, "intro"), (wiki_types, "wiki_type"), (structured, "structured_type")):
        t = t.join(other.select("kb_id", c), "kb_id", "left")
    return t.withColumns({"title": F.coalesce("title", F.lit("None")), "intro": F.coalesce("intro", F.lit("None")), "wiki_type": F.coalesce("wiki_type", F.lit(""))})


def coref_spans(spark: SparkSession, path: str) -> DataFrame:
    """`id TAB [a, b] ...` -> (query_id, spans array<struct<start, end>>), both ends inside."""
    f = _fields(spark, path)
    number = lambda x, i: F.expr("0") + F.regexp_extract(x, r"^.\s*(-?\d+)\s*,\s*(-?\d+)", i).cast("int")
    spans = F.transform(F.filter(F.slice("f", 2, F.size("f")), lambda x: x.rlike(r"^.\s*-?\d+\s*,\s*-?\d+")), lambda x: F.struct(number(x, 1).alias("start"), number(x, 2).alias("end")))
    return f.select(F.get("f", F.lit(0)).alias("query_id"), spans.alias("spans"))


def string_lists(spark: SparkSession, path: str, key: str = "query_id", values: str = "mentions") -> DataFrame:
    """`id TAB s1 TAB s2 ...` -> (key, values): coreference strings, or named entities of knowledge-base entries."""
    return _fields(spark, path).select(F.get("f", F.lit(0)).alias(key), F.slice("f", 2, F.size("f")).alias(values))


def named_entities(spark: SparkSession, path: str) -> DataFrame:
    """Records of four lines -> (query_id, ner_type, matching, orgs, locs, people): id, type and matching entities; then organizations,
    locations and people, each after a blank and a tag. The type is "None" where it is missing.

    A record's lines belong to the last line before them that has an id; lines that stand first in a piece of a file, to the last of the pieces before.
    """
    lines = _fields(spark, path).where(F.size("f") > 0).where(~((F.size("f") == 1) & (F.get("f", F.lit(0)) == "")))
    lines = lines.withColumns({"piece": F.shiftright("line_no", 33), "head": F.when(F.get("f", F.lit(0)) != "", F.col("line_no"))})
    own = Window.partitionBy("piece").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    last = lines.groupBy("piece").agg(F.max("head").alias("last")).select("piece", F.max("last").over(before).alias("earlier"))
    at = lines.withColumn("own", F.max("head").over(own)).join(last, "piece").withColumn("rec", F.coalesce("own", "earlier")).where("rec is not null")
    tag = F.when(F.col("head").isNotNull(), "").otherwise(F.get("f", F.lit(1)))
    parts = {"p0": "", "orgs": "ORGANIZATION", "locs": "LOCATION", "people": "PERSON"}
    rec = at.withColumn("tag", tag).groupBy("rec").agg(*[F.first(F.when(F.col("tag") == t, F.col("f")), ignorenulls=True).alias(c) for c, t in parts.items()])
    rest = lambda c: F.filter(F.slice(F.coalesce(c, F.array().cast("array<string>")), 3, 1 << 20), lambda x: x != "")
    return rec.select(F.get("p0", F.lit(0)).alias("query_id"), F.coalesce(F.nullif(F.get("p0", F.lit(1)), F.lit("")), F.lit("None")).alias("ner_type"), rest("p0").alias("matching"), *[rest(c).alias(c) for c in ("orgs", "locs", "people")])


def gazetteer(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """Lines of `Name (KIND ...)` pairs -> places(name_lc, kind), city_in(container, city, kind): the first name of a line lies in the provinces and countries after it."""
    lines = _lines(spark, path, encoding)
    pairs = F.transform(F.regexp_extract_all("value", F.lit(r"([^()]+\([A-Z]+[^()]*\))"), F.lit(1)), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^(]+)\(", 1)).alias("name"), F.regexp_extract(x, r"\(([A-Z]+)", 1).alias("kind")))
    at = lines.select(pairs.alias("p")).where(F.size("p") > 0)
    kind = F.when(F.col("x.kind") == "CITY", "city").when(F.col("x.kind") == "PROVINCE", "state").when(F.col("x.kind") == "COUNTRY", "country")
    places = at.select(F.explode("p").alias("x")).select(F.lower("x.name").alias("name_lc"), kind.alias("kind")).where("kind is not null").distinct()
    cities = at.where(F.get("p", F.lit(0))["kind"] == "CITY").select(F.get("p", F.lit(0))["name"].alias("city"), F.explode(F.slice("p", 2, F.size("p"))).alias("x"))
    return places, cities.select(F.col("x.name").alias("container"), "city", kind.alias("kind")).where("kind in ('state', 'country')").distinct()


def word_list(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(word): lower-cased. Stop words part by commas; for surnames, sep TAB takes what stands before the first."""
    f = _lines(spark, path).select(F.split("value", sep, -1).alias("f"))
    word = F.explode("f") if sep == "," else F.get("f", F.lit(0))
    return f.select(word.alias("w")).select(F.lower(F.trim("w")).alias("word")).where("word <> ''").distinct()


def link_training(spark: SparkSession, path: str) -> DataFrame:
    """(label, query_id, used, expected), label true for CORRECT; lines of fewer than four fields are passed over."""
    f = _fields(spark, path).where(F.size("f") >= 4)
    return f.select((F.get("f", F.lit(0)) == "CORRECT").alias("label"), *[F.get("f", F.lit(i)).alias(c) for i, c in ((1, "query_id"), (2, "used"), (3, "expected"))])


def linear_model(spark: SparkSession, path: str) -> tuple[dict[str, float], float]:
    """(weights, intercept) of `name TAB weight` lines: a few for each feature of a model."""
    rows = _fields(spark, path).where(F.size("f") == 2).select(F.get("f", F.lit(0)).alias("k"), F.get("f", F.lit(1)).cast("double").alias("v")).collect()
    all_ = {r["k"]: r["v"] for r in rows}
    return {k: v for k, v in all_.items() if k != "Intercept"}, all_.get("Intercept", 0.0)


def benchmark_report(spark: SparkSession, path: str) -> DataFrame:
    """(outcome, query_id, name, entity, kb_title) of report lines with over nine fields."""
    f = _fields(spark, path).where(F.size("f") > 9)
    return f.select(*[F.get("f", F.lit(i)).alias(c) for i, c in ((0, "outcome"), (3, "query_id"), (4, "name"), (5, "entity"), (9, "kb_title"))])


def kb_xml(spark: SparkSession, path: str) -> DataFrame:
    """Files of <entity> elements, however deep -> (kb_id, title, entity_type, wiki_type, text)."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    e = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<entity .*?</entity>)"), F.lit(1))).alias("x"))
    attr = lambda k: F.regexp_extract("x", rf'<entity[^>]*\b{k}="([^"]*)"', 1)
    return e.select(attr("id").alias("kb_id"), attr("name").alias("title"), attr("type").alias("entity_type"), F.regexp_extract("x", r'<facts class="([^"]*)"', 1).alias("wiki_type"), F.regexp_extract("x", r"(?s)<wiki_text><!\[CDATA\[(.*?)\]\]>", 1).alias("text"))


def with_documents(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """queries with the text of their document, read once; "" where the document is missing or there are several. Texts that no query asks for are not shuffled."""
    asked = documents.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    one = asked.groupBy(F.col("doc_id").alias("__d")).agg(F.count("*").alias("__n"), F.first("text").alias("text")).where("__n = 1").drop("__n")
    return queries.join(one, F.col("doc_id") == F.col("__d"), "left").drop("__d").withColumn("text", F.coalesce("text", F.lit("")))


def extractions_near(queries: DataFrame, extractions: DataFrame, reach: int = 500, limit: int = 10_000) -> DataFrame:
    """(query_id, args): proper arguments that start within `reach` of the mention, by offset, of the document's first `limit` extractions.

    extractions(doc_id, sentence_start, arg_tokens array<struct<string, start, is_proper>>, ord).
    """
    e = extractions.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("__r") <= limit)
    proper = F.filter("arg_tokens", lambda t: t["is_proper"])
    e = e.select("doc_id", (F.col("sentence_start") + F.get("arg_tokens", F.lit(0))["start"]).alias("at"), F.array_join(F.transform(proper, lambda t: t["string"]), " ").alias("arg")).where("arg <> ''")
    met = queries.select("query_id", "doc_id", "beg", "entity").join(e, "doc_id").where((F.abs(F.col("beg") - F.col("at")) < reach) & (F.lower("arg") != F.lower("entity")))
    return met.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "arg"))), lambda x: x["arg"]).alias("args"))


#: Fields of an extraction, in the order of a line.
EXTRACTION = "doc_id string, sentence_start int, arg1 string, rel string, arg2 string, arg1_node string, arg2_node string, confidence double"


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of eight fields, parted by TAB -> EXTRACTION; a field that is empty or no number is null, lines of another length are passed over."""
    f = _fields(spark, path).where(F.size("f") == 8)
    names = [x.strip().split(" ") for x in EXTRACTION.split(",")]
    return f.select(*[F.expr(f"try_cast(nullif(f[{i}], '') as {kind})").alias(name) for i, (name, kind) in enumerate(names)])


def corpus_documents(queries: DataFrame, corpora: dict[str, DataFrame]) -> DataFrame:
    """with_documents() of the corpus that each query's year picks; corpora: year -> documents(doc_id, text). A year without a corpus is an error."""
    years = {r["year"] for r in queries.select("year").distinct().collect()}
    if unknown := sorted(str(y) for y in years - set(corpora)):
        raise ValueError(f"no documents for {', '.join(unknown)}")
    out = None
    for year in sorted(years):
        one = with_documents(queries.where(F.col("year") == year), corpora[year])
        out = one if out is None else out.union(one)
    return queries.withColumn("text", F.lit("")) if out is None else out
