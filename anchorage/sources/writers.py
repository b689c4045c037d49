"""Writers of answers, reports, annotation tables and knowledge-base maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import two_decimals


def submission(answers: DataFrame) -> DataFrame:
    """(value): `id TAB link TAB confidence` of each answer in the order of pos."""
    return answers.orderBy("pos").select(F.concat_ws("\t", "query_id", "kb_link", two_decimals("confidence")).alias("value"))


def human_readable(answers: DataFrame, queries: DataFrame, kb: DataFrame) -> DataFrame:
    """query_id, name, entity, doc_id, context, kb_link, kb_title, kb_sentence; what the knowledge base lacks is "None"."""
    q = queries.select("query_id", "pos", "doc_id", "context")
    k = kb.select(F.col("kb_id").alias("kb_link"), F.col("title").alias("kb_title"), F.col("intro").alias("kb_sentence"))
    out = answers.select("query_id", "name", "entity", "kb_link").join(q, "query_id").join(k, "kb_link", "left").fillna("None", ["kb_title", "kb_sentence"])
    return out.orderBy("pos").select("query_id", "name", "entity", "doc_id", "context", "kb_link", "kb_title", "kb_sentence")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_queries_xml(queries: DataFrame, path: str) -> None:
    """queries(query_id, name, doc_id[, beg, end]) as <query id> elements, a root in each file."""
    rest = [c for c in ("beg", "end") if c in queries.columns]
    x = queries.select(F.col("query_id").alias("_id"), "name", F.col("doc_id").alias("docid"), *rest)
    x.write.format("xml").option("rootTag", "kbpentlink").option("rowTag", "query").mode("overwrite").save(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def span_lines(spans: DataFrame) -> DataFrame:
    """(value): `id TAB [a, b] ...`."""
    shown = F.transform("spans", lambda s: F.format_string("[%d, %d]", s["start"], s["end"]))
    return spans.select(F.concat_ws("\t", F.col("query_id"), shown).alias("value"))


def entity_lines(annotated: DataFrame) -> DataFrame:
    """(value): the four lines of each query's named entities, as one string."""
    tagged = lambda tag, c: F.concat_ws("\t", F.lit(""), F.lit(tag), F.col(c))
    head = F.concat_ws("\t", F.col("query_id"), F.col("ner_type"), F.col("matching"))
    return annotated.select(F.concat_ws("\n", head, tagged("ORGANIZATION", "orgs"), tagged("LOCATION", "locs"), tagged("PERSON", "people")).alias("value"))


def mention_lines(mentions: DataFrame) -> DataFrame:
    """(value): `id TAB distinct mentions`."""
    return mentions.select(F.concat_ws("\t", F.col("query_id"), F.array_distinct("mentions")).alias("value"))


def representative_lines(annotated: DataFrame) -> DataFrame:
    """(value): `id TAB longest mention of its chain`."""
    longest = F.get(F.array_sort(F.transform("mentions", lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m")))), F.lit(0))["m"]
    return annotated.select(F.concat_ws("\t", F.col("query_id"), F.coalesce(longest, F.lit(""))).alias("value"))


def type_lines(annotated: DataFrame) -> DataFrame:
    return annotated.select(F.concat_ws("\t", F.col("query_id"), F.col("ner_type"), F.col("matching")).alias("value"))


def alternate_lines(mentions: DataFrame) -> DataFrame:
    """(value): id, document, name and expanded name of each mention that has one."""
    return mentions.where("entity <> name").select(F.concat_ws("\t", "query_id", "doc_id", "name", "entity").alias("value"))


def kb_maps(kb: DataFrame, root: str) -> None:
    """The maps of a knowledge base: intro, first paragraphs, title, type, and structured type with its columns turned round."""
    for name, columns in (("intro", ("kb_id", "intro")), ("first_paragraph", ("kb_id", "first_paragraph")), ("title", ("kb_id", "title")), ("wiki_type", ("kb_id", "wiki_type")), ("structured_type", ("structured_type", "kb_id"))):
        if set(columns) <= set(kb.columns):
            write_tsv(kb.select(*columns), f"{root}/{name}")


def linear_model_lines(spark, weights: dict[str, float], intercept: float) -> DataFrame:
    """(value): `name TAB weight` by name, and the intercept."""
    return spark.createDataFrame([(f"{k}\t{v}",) for k, v in sorted({**weights, "Intercept": intercept}.items())], "value string").coalesce(1)


def ensure(spark, path: str, make) -> DataFrame:
    """The Parquet table at path, made by make() if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.parquet(path)
    return spark.read.parquet(path)
