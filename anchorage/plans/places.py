"""Queries over the places of names in the documents' own texts, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import occurrences
from .registry import query, table

#: Capital words of each text with their places. A name of this form stands wherever a capital word begins with it.
NAMES = """with d as (select doc_id, coalesce(text, '') as text from documents),
r as (select doc_id, regexp_extract_all(text, '[A-Z][a-z]+') as m, string_split_regex(text, '[A-Z][a-z]+') as g from d),
u as (select doc_id, unnest(m) as word, unnest(range(1, len(m) + 1)) as i, unnest(g[:len(m)]) as gap from r),
w as (select doc_id, word, sum(length(gap) + length(word)) over (partition by doc_id order by i) - length(word) as b from u),
n as (select distinct doc_id, word as name from w),
o as (select doc_id, name, b, b + length(name) - 1 as e from (select doc_id, b, left(word, unnest(range(2, length(word) + 1))) as name from w) join n using (doc_id, name))"""


def parts(texts: DataFrame, mark: str) -> DataFrame:
    """texts(doc_id, text) -> (doc_id, start, n): where the parts between marks of one character begin and how long they are. Only lengths are shuffled."""
    each = texts.select("doc_id", F.posexplode(F.transform(F.split("text", mark, -1), F.length)).alias("i", "n"))
    ahead = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("start", F.sum(F.col("n") + 1).over(ahead) - F.col("n") - 1).select("doc_id", "start", "n")


def capital_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents' texts, and the places of each one's capital words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = d.withColumn("names", F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1))))
    return d, occurrences.occurrences(names, "doc_id", "text", "names")


@query(NAMES + """ select doc_id, name, count(*) as n_places, min(b)::bigint as first_place, max(b)::bigint as last_place from o group by all""")
def entity_places(spark, sf_dir):
    """Every capital word of a document with the number of its places, the insides of other words included."""
    p = capital_words(spark, sf_dir)[1]
    return p.groupBy("doc_id", "name").agg(F.count("*").alias("n_places"), F.min("start").alias("first_place"), F.max("start").alias("last_place"))


@query(NAMES + """, x as (select doc_id, unnest(string_split(text, '.')) as t, unnest(range(1, len(string_split(text, '.')) + 1)) as i from d),
a as (select doc_id, sum(length(t) + 1) over (partition by doc_id order by i) - length(t) - 1 as b, length(t) as n from x)
select doc_id, name, count(*) as n_held, count(*) filter (a.n > 40) as n_in_long, min(a.b)::bigint as first_span from o join a using (doc_id) where n > 0 and o.b >= a.b and o.e <= a.b + least(a.n, 40) - 1 group by all""")
def entity_span_containment(spark, sf_dir):
    """Places of capital words that lie wholly within the first 40 characters of a sentence."""
    d, p = capital_words(spark, sf_dir)
    heads = parts(d, "[.]").where("n > 0").select("doc_id", "start", (F.col("start") + F.least("n", F.lit(40)) - 1).alias("end"), "n")
    held = occurrences.within(p, heads, "doc_id", "n")
    return held.groupBy("doc_id", "name").agg(F.count("*").alias("n_held"), F.count_if(F.col("n") > 40).alias("n_in_long"), F.min("span_start").alias("first_span"))
