"""The linker as a whole: a base folder made from the tables, linked from its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store, writers
from . import system
from .registry import query, rounded, table

#: A name of three words in a text, of which the first is a mention and the first two are a name of their own.
FULL = "[A-Z][a-z]+ [a-z]+ [a-z]+"
YEAR = "2012"


def base_folder(spark: SparkSession, documents: DataFrame) -> str:
    """A base folder (see system) of documents(doc_id, text): a query for each, whose name is the first word of a name in
    the text. Names are of four kinds by their first document: in the knowledge base and often meant by their string;
    in it and seldom meant; meant but not in it; in neither, of which half begin with a name that is. Documents without a
    name, and every seventh, have no annotation."""
    base = store.folder(spark)
    name_id = F.concat(F.lit("Q"), "doc_id")
    d = documents.select("doc_id", "text", F.regexp_extract(F.coalesce("text", F.lit("")), FULL, 0).alias("full"))
    d.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text").write.parquet(f"{base}/documents_{YEAR}")
    named = store.written(d.select("doc_id", "full"), base, "named")
    short = F.when(F.col("full") == "", "none").otherwise(F.substring_index("full", " ", 1))
    writers.write_queries_xml(named.select(name_id.alias("query_id"), short.alias("name"), F.concat(F.lit("d"), "doc_id").alias("doc_id")), f"{base}/queries_{YEAR}.xml")
    none = F.array().cast("array<string>")
    known = named.where((F.col("full") != "") & (F.col("doc_id") % 7 != 0))
    people = known.select(name_id.alias("query_id"), F.lit("PERSON").alias("ner_type"), none.alias("matching"), none.alias("orgs"), none.alias("locs"), F.array("full").alias("people"))
    writers.write_lines(writers.entity_lines(people), f"{base}/entities_{YEAR}")
    ids = lambda c: named.where(F.col("full") != "").groupBy(c.alias("title")).agg(F.min("doc_id").alias("id"))
    full, prefix = ids(F.col("full")).withColumn("kind", F.col("id") % 4), ids(F.substring_index("full", " ", 2)).where("id % 2 = 0")
    kb = full.where("kind < 2").select(F.concat(F.lit("E"), "id").alias("kb_id"), "title").union(prefix.select(F.concat(F.lit("P"), "id"), "title"))
    kb = kb.select("kb_id", "title", F.col("title").alias("intro"), F.lit("person").alias("wiki_type"), F.lit("PER").alias("structured_type"))
    writers.kb_maps(store.written(kb, base, "entries"), f"{base}/kb")
    share = F.when(F.col("kind") == 0, 97).when(F.col("kind") == 1, 50).otherwise(98)
    meant = F.when(F.col("kind") == 2, F.concat("title", F.lit(" (x)"))).otherwise(F.col("title"))
    some = full.where("kind < 3")
    anchors = some.select(F.col("title").alias("surface"), meant.alias("kb_name"), share.cast("long").alias("n")).union(some.select("title", F.lit("other"), (100 - share).cast("long")))
    anchors.union(prefix.select("title", "title", F.lit(5).cast("long"))).write.parquet(f"{base}/anchors")
    return base


CONF = "(trunc(100 * {s} - 100 * 0.93::double)::double * (20 / ((1 - 0.93::double) * 100)) + 80) / 100"
SYSTEM = f"""with m as (select doc_id, regexp_extract(coalesce(text, ''), '{FULL}') as whole, doc_id % 7 <> 0 as seen from documents),
f as (select whole, min(doc_id) as id, min(doc_id) % 4 as kind from m where whole <> '' group by whole),
p as (select array_to_string(string_split(whole, ' ')[1:2], ' ') as prefix, min(doc_id) as id from m where whole <> '' group by 1),
d as (select m.doc_id, case when m.whole = '' then 'none' else string_split(m.whole, ' ')[1] end as name, m.whole,
  case when m.whole = '' or not seen then 9 when f.kind = 3 and p.id % 2 = 0 then 4 else f.kind end as kind, f.id, p.id as pid, p.prefix
  from m left join f on f.whole = m.whole left join p on p.prefix = array_to_string(string_split(m.whole, ' ')[1:2], ' ')),
l as (select 'Q' || doc_id as query_id, name, case kind when 9 then name when 4 then prefix else whole end as entity,
  case when kind < 2 then 'E' || id when kind = 4 then 'P' || pid end as kb_id,
  case kind when 9 then 0.1 when 0 then {CONF.format(s='0.97::double')} when 1 then 0.8 when 4 then {CONF.format(s='1.0::double')} else 0.6 end::double as confidence from d)
select query_id, name, entity, kb_id, round(confidence, 6) as confidence,
  case when kb_id is not null then min(query_id) over (partition by kb_id) when confidence = 0.6 then min(query_id) over (partition by kb_id, entity, confidence) else query_id end as first_of_cluster from l"""


@query(SYSTEM)
def system_link(spark, sf_dir):
    """A query for each document through all stages of the linker, by way of files; clusters are named by their first query."""
    out = system.link(spark, base_folder(spark, table(spark, sf_dir, "documents")), YEAR)
    first = out.groupBy(F.col("kb_link").alias("__l")).agg(F.min("query_id").alias("first_of_cluster"))
    linked = F.when(~F.startswith("kb_link", F.lit("NIL")), F.col("kb_link"))
    return rounded(out.join(first, F.col("kb_link") == F.col("__l")).select("query_id", "name", "entity", linked.alias("kb_id"), "confidence", "first_of_cluster"), "confidence")
