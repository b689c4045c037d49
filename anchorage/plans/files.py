"""Queries that write a file of each format from a table and read it back; the SQL says what must come back from the table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, store, writers
from .registry import query, table


def written(spark: SparkSession, lines: DataFrame, key: str | None = None, order: str | None = None) -> str:
    """The path of text files with lines(value); the lines of a key, if one is given, stand in one file in that order."""
    path = store.folder(spark)
    writers.write_lines((lines.repartition(key).sortWithinPartitions(order) if key else lines).select("value"), path)
    return path


def line(*parts, sep: str = "\t"):
    return F.concat_ws(sep, *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]).alias("value")


def capitals(n: int = 5):
    return F.slice(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1)), 1, n)


CAPITALS = "regexp_extract_all(text, '[A-Z][a-z]+')[1:5]"


@query("""select 'EL' || doc_id as query_id, source as name, lang || doc_id as doc_id, case when doc_id % 5 = 0 then -1 else (doc_id % 90)::int end as beg,
case when doc_id % 5 = 0 then -1 else (doc_id % 90 + 7)::int end as end from documents""")
def query_file(spark, sf_dir):
    """Queries in XML; every fifth lacks an offset or has one that is no number."""
    d = table(spark, sf_dir, "documents")
    beg = F.when(F.col("doc_id") % 10 == 0, F.lit("")).when(F.col("doc_id") % 5 == 0, F.lit("none")).otherwise((F.col("doc_id") % 90).cast("string"))
    q = d.select(F.concat(F.lit("EL"), "doc_id").alias("query_id"), F.col("source").alias("name"), F.concat("lang", "doc_id").alias("doc_id"), beg.alias("beg"), (F.col("doc_id") % 90 + 7).alias("end"))
    path = store.folder(spark)
    writers.write_queries_xml(q, path)
    return readers.queries_xml(spark, path).select("query_id", "name", "doc_id", "beg", "end")


@query("""select doc_id::varchar as query_id, 'E' || source as kb_link, case when doc_id % 3 > 0 then lang end as entity_type,
case when doc_id % 3 > 1 then 'web' end as genre, 0.0::double as confidence from documents where doc_id % 7 > 0""")
def answer_file(spark, sf_dir):
    """Answers with two to four fields; a line of one field is none."""
    d = table(spark, sf_dir, "documents")
    short = F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("E"), "source"))
    value = F.concat_ws("\t", F.col("doc_id").cast("string"), short, F.when(short.isNotNull() & (F.col("doc_id") % 3 > 0), F.col("lang")), F.when(short.isNotNull() & (F.col("doc_id") % 3 > 1), F.lit("web")))
    return readers.answers_tsv(spark, written(spark, d.select(value.alias("value")))).select("query_id", "kb_link", "entity_type", "genre", "confidence")


@query("""select doc_id::varchar as query_id, kb_link from (select doc_id,
case when doc_id % 2 = 0 then 'E' || source else 'NIL' || lpad(doc_id::varchar, greatest(4, length(doc_id::varchar))::int, '0') end as kb_link from documents)""")
def submission_file(spark, sf_dir):
    """Answers as they are submitted, in the order of their queries."""
    link = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("E"), "source")).otherwise(F.concat(F.lit("NIL"), F.expr("lpad(cast(doc_id as string), greatest(4, length(cast(doc_id as string))), '0')")))
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("query_id"), link.alias("kb_link"), F.lit(0.8).alias("confidence"))
    return readers.answers_tsv(spark, written(spark, writers.submission(a))).select("query_id", "kb_link")


@query("""select doc_id::varchar || chr(9) || source || chr(9) || lang || ' ' || source || chr(9) || 'd' || doc_id || chr(9) || n_chars || chr(9) || coalesce('E' || p_partkey, 'NIL' || doc_id) || chr(9) || coalesce(p_name, 'None') || chr(9) || coalesce(p_type, 'None') as line
from documents left join part on p_partkey = doc_id and doc_id % 3 > 0""")
def readable_file(spark, sf_dir):
    """Answers with their context and what the knowledge base says of their link."""
    d = table(spark, sf_dir, "documents")
    kb = table(spark, sf_dir, "part").select(F.concat(F.lit("E"), "p_partkey").alias("kb_id"), F.col("p_name").alias("title"), F.col("p_type").alias("intro"))
    known = kb.select(F.col("kb_id").alias("kb_link"))
    link = d.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("E"), "doc_id")).alias("__l")).join(known, F.col("__l") == F.col("kb_link"), "left").select("doc_id", F.coalesce("kb_link", F.concat(F.lit("NIL"), "doc_id")).alias("kb_link"))
    a = d.join(link, "doc_id").select(F.col("doc_id").alias("query_id"), F.col("source").alias("name"), F.concat_ws(" ", "lang", "source").alias("entity"), "kb_link")
    q = d.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("n_chars").cast("string").alias("context"))
    path = store.folder(spark)
    writers.write_tsv(writers.human_readable(a, q, kb), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def part_lines(spark, sf_dir, key, *parts):
    """Lines of parts; those that name the same entity, by the key, in the order of their parts, as the last of them counts."""
    return written(spark, table(spark, sf_dir, "part").select("p_partkey", F.expr(key).alias("key"), line(*parts)), "key", "p_partkey")


KEY = "p_partkey % 50"


@query("select p_name as title, max_by('E' || p_partkey, p_partkey) as kb_id, max_by(p_type, p_partkey) as entity_type from part where p_partkey % 9 > 0 group by p_name")
def kb_name_file(spark, sf_dir):
    """Names to entities; lines with more fields are cut, with fewer passed over, the last of a name counts."""
    rest = F.when(F.col("p_partkey") % 9 > 0, F.col("p_type"))
    path = part_lines(spark, sf_dir, "p_name", F.concat(F.lit("E"), "p_partkey"), "p_name", rest, F.when(F.col("p_partkey") % 4 == 0, F.when(rest.isNotNull(), F.lit("more"))))
    return readers.kb_map(spark, path, ("kb_id", "title", "entity_type"), "title", exact=False).select("title", "kb_id", "entity_type")


@query(f"select 'E' || {KEY} as kb_id, max_by(p_name, p_partkey) as title from part where p_partkey % 8 > 0 group by 1")
def kb_title_file(spark, sf_dir):
    """Entities to titles; lines of three fields are passed over."""
    path = part_lines(spark, sf_dir, KEY, F.concat(F.lit("E"), F.expr(KEY)), "p_name", F.when(F.col("p_partkey") % 8 == 0, F.lit("x")))
    return readers.kb_map(spark, path, ("kb_id", "title"), "kb_id").select("kb_id", "title")


@query("select p_name as title, max_by('E' || p_partkey, p_partkey) as kb_id from part group by p_name")
def kb_title_reversed_file(spark, sf_dir):
    return readers.kb_map(spark, part_lines(spark, sf_dir, "p_name", F.concat(F.lit("E"), "p_partkey"), "p_name"), ("kb_id", "title"), "title").select("title", "kb_id")


def kb_table(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("E"), "p_partkey").alias("kb_id"), F.col("p_name").alias("title"), F.col("p_type").alias("wiki_type"), F.concat_ws(" ", "p_name", "p_type").alias("intro"), F.concat("p_name", F.lit(" first")).alias("first_paragraph"), F.substring("p_type", 1, 3).alias("structured_type"))


@query("select 'E' || p_partkey as kb_id, p_name as title, p_name || ' ' || p_type as intro, p_type as wiki_type, substring(p_type, 1, 3) as structured_type from part")
def kb_map_files(spark, sf_dir):
    """All maps of a knowledge base, written and joined to one table again."""
    root = store.folder(spark)
    writers.kb_maps(kb_table(spark, sf_dir), root)
    read = lambda name, columns: readers.kb_map(spark, f"{root}/{name}", columns, "kb_id")
    kb = readers.knowledge_base(read("title", ("kb_id", "title")), read("intro", ("kb_id", "intro")), read("wiki_type", ("kb_id", "wiki_type")), read("structured_type", ("structured_type", "kb_id")))
    return kb.select("kb_id", "title", "intro", "wiki_type", "structured_type")


@query("select 'E' || p_partkey as kb_id, case when p_partkey % 3 = 0 then '' else p_type end as context from part")
def kb_context_file(spark, sf_dir):
    return readers.kb_context(spark, part_lines(spark, sf_dir, "p_partkey", F.concat(F.lit("E"), "p_partkey"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")))).select("kb_id", "context")


SPANS = "list_transform(range(0, (doc_id % 4)::bigint), lambda x: x * 10 + doc_id % 7)"


@query(f"select doc_id::varchar as query_id, array_to_string(list_transform({SPANS}, lambda x: x || '-' || (x + 5)), ' ') as spans from documents")
def coref_span_file(spark, sf_dir):
    """Spans of coreferent mentions, none to three for a query."""
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("doc_id") % 4), lambda i: (i * 10 + F.col("doc_id") % 7).cast("int"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("query_id"), F.transform(starts, lambda s: F.struct(s.alias("start"), (s + 5).alias("end"))).alias("spans"))
    got = readers.coref_spans(spark, written(spark, writers.span_lines(d)))
    return got.select("query_id", F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " ").alias("spans"))


@query(f"""select doc_id::varchar as query_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'i': i, 'w': w[i]}}), lambda x: list_position(w, x.w) = x.i), lambda x: x.w), ' ') as mentions
from (select doc_id, {CAPITALS} as w from documents)""")
def coref_string_file(spark, sf_dir):
    """Distinct mentions of a query's chain, in their order."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), capitals().alias("mentions"))
    return readers.string_lists(spark, written(spark, writers.mention_lines(d))).select("query_id", F.array_join("mentions", " ").alias("mentions"))


@query(f"""select doc_id::varchar as query_id,
coalesce(case when doc_id % 3 > 0 then 'PERSON' end, 'None') as ner_type, array_to_string(w[5:5], ' ') as matching, array_to_string(w[1:2], ' ') as orgs, array_to_string(w[3:3], ' ') as locs, array_to_string(w[4:4], ' ') as people
from (select doc_id, {CAPITALS} as w from documents)""")
def named_entity_file(spark, sf_dir):
    """Records of four lines: a query's type and matching entities, then its organizations, locations and people."""
    w = capitals()
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 3 > 0, "PERSON").otherwise("").alias("ner_type"), F.slice(w, 5, 1).alias("matching"),
        F.slice(w, 1, 2).alias("orgs"), F.slice(w, 3, 1).alias("locs"), F.slice(w, 4, 1).alias("people"),
    )
    got = readers.named_entities(spark, written(spark, writers.entity_lines(d)))
    return got.select("query_id", "ner_type", *[F.array_join(c, " ").alias(c) for c in ("matching", "orgs", "locs", "people")])


@query(f"""select doc_id::varchar as query_id, array_to_string(list_concat([case when doc_id % 3 = 0 then 'None' else 'ORGANIZATION' end], w[1:2]), ' ') as fields
from (select doc_id, {CAPITALS} as w from documents)""")
def entity_type_file(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 3 == 0, "None").otherwise("ORGANIZATION").alias("ner_type"), F.slice(capitals(), 1, 2).alias("matching"))
    return readers.string_lists(spark, written(spark, writers.type_lines(d)), values="fields").select("query_id", F.array_join("fields", " ").alias("fields"))


@query(f"""select doc_id::varchar as query_id, coalesce(list_sort(list_transform(w, lambda x: {{'n': -length(x), 'x': x}}))[1].x, '') as mention
from (select doc_id, {CAPITALS} as w from documents)""")
def representative_file(spark, sf_dir):
    """The longest mention of a chain; of several the first by text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), capitals().alias("mentions"))
    got = readers.string_lists(spark, written(spark, writers.representative_lines(d)))
    return got.select("query_id", F.coalesce(F.get("mentions", F.lit(0)), F.lit("")).alias("mention"))


@query("select doc_id::varchar as query_id, 'd' || doc_id || ' ' || source || ' ' || lang || source as fields from documents where doc_id % 2 = 0")
def alternate_name_file(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("source").alias("name"), F.when(F.col("doc_id") % 2 == 0, F.concat("lang", "source")).otherwise(F.col("source")).alias("entity"))
    return readers.string_lists(spark, written(spark, writers.alternate_lines(d)), values="fields").select("query_id", F.array_join("fields", " ").alias("fields"))


@query("""select lower('Ä' || n_name) as name,
case when n_regionkey = 0 then 'city' when n_regionkey = 1 then 'state' else 'country' end as kind, 'places' as part from nation union all
select 'É' || r_name, case when r_regionkey % 2 = 0 then 'state' else 'country' end || ': Ä' || n_name, 'within' from nation
join region on r_regionkey = n_regionkey where n_regionkey = 0 union select lower('É' || r_name),
case when r_regionkey % 2 = 0 then 'state' else 'country' end, 'places' from nation join region on r_regionkey = n_regionkey""")
def gazetteer_file(spark, sf_dir):
    """Places by kind and cities within them, from a file in ISO-8859-1."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    kind = F.when(F.col("n_regionkey") == 0, "CITY").when(F.col("n_regionkey") == 1, "PROVINCE").otherwise("COUNTRY")
    around = F.when(F.col("r_regionkey") % 2 == 0, "PROVINCE").otherwise("COUNTRY")
    value = F.format_string("Ä%s (%s 12) É%s (%s)", "n_name", kind, "r_name", around)
    path = store.folder(spark)
    n.select(value).write.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "\x02").csv(path)
    places, within = readers.gazetteer(spark, path)
    return places.select(F.col("name_lc").alias("name"), "kind", F.lit("places").alias("part")).union(within.select("container", F.concat_ws(": ", "kind", "city"), F.lit("within")))


@query("""select 'E' || p_partkey as kb_id, p_name as title, substring(p_type, 1, 3) as entity_type, p_brand as wiki_type, p_name || chr(10) || chr(10) || p_type as text
from part""")
def kb_xml_files(spark, sf_dir):
    """Entities in XML files of folders below one another."""
    p = table(spark, sf_dir, "part")
    body = F.format_string('<entity wiki_title="w" type="%s" id="E%d" name="%s">\n<facts class="%s"><fact name="x">y</fact></facts>\n<wiki_text><![CDATA[%s\n\n%s]]></wiki_text>\n</entity>', F.substring("p_type", 1, 3), "p_partkey", "p_name", "p_brand", "p_name", "p_type")
    root = store.folder(spark)
    for i in range(2):
        writers.write_lines(p.where(F.col("p_partkey") % 2 == i).select(body.alias("value")), f"{root}/deep/part{i}")
    return readers.kb_xml(spark, root).select("kb_id", "title", "entity_type", "wiki_type", "text")


@query(f"select 'E' || doc_id as kb_id, array_to_string({CAPITALS}, ' ') as entities from documents")
def kb_entity_file(spark, sf_dir):
    """Named entities of knowledge-base entries."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("\t", F.concat(F.lit("E"), "doc_id"), capitals()).alias("value"))
    return readers.string_lists(spark, written(spark, d), "kb_id", "entities").select("kb_id", F.array_join("entities", " ").alias("entities"))


@query("select doc_id % 2 = 0 as label, doc_id::varchar as query_id, source as used, lang as expected from documents where doc_id % 6 > 0")
def link_training_file(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    some = F.col("doc_id") % 6 > 0
    value = F.concat_ws("\t", F.when(F.col("doc_id") % 2 == 0, "CORRECT").otherwise("WRONG"), F.col("doc_id").cast("string"), F.when(some, F.col("source")), F.when(some, F.col("lang")))
    return readers.link_training(spark, written(spark, d.select(value.alias("value"))))


@query("select distinct lower(n_name) as word from nation")
def surname_file(spark, sf_dir):
    return readers.word_list(spark, written(spark, table(spark, sf_dir, "nation").select(line("n_name", "n_nationkey"))), sep="\t")


@query("select distinct lower(trim(w)) as word from (select unnest(string_split(p_name || ', ' || p_type, ',')) as w from part) where trim(w) <> ''")
def stop_word_file(spark, sf_dir):
    return readers.word_list(spark, written(spark, table(spark, sf_dir, "part").select(F.concat_ws(", ", "p_name", "p_type").alias("value"))))


@query("select 'w' || n_nationkey as feature, round(n_nationkey / 7.0::double, 6) as weight from nation union all select 'Intercept', -0.5::double")
def linear_model_file(spark, sf_dir):
    """Weights by feature and the intercept, saved and loaded."""
    n = {f"w{r['n_nationkey']}": r["n_nationkey"] / 7.0 for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()}  # a model has a few features
    weights, intercept = readers.linear_model(spark, written(spark, writers.linear_model_lines(spark, n, -0.5)))
    return spark.createDataFrame([*weights.items(), ("Intercept", intercept)], "feature string, weight double").withColumn("weight", F.round("weight", 6))


@query("""select case when doc_id % 2 = 0 then 'CORRECT' else 'EXP NIL' end as outcome, doc_id::varchar as query_id, source as name, lang as entity, 'E' || source as kb_title
from documents where doc_id % 4 > 0""")
def benchmark_report_file(spark, sf_dir):
    """Report lines of ten fields; shorter ones are passed over."""
    d = table(spark, sf_dir, "documents")
    some = lambda c: F.when(F.col("doc_id") % 4 > 0, c)
    fields = [F.when(F.col("doc_id") % 2 == 0, "CORRECT").otherwise("EXP NIL"), F.lit("a"), F.lit("b"), F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.lit("c"), F.lit("d"), F.lit("e")]
    return readers.benchmark_report(spark, written(spark, d.select(F.concat_ws("\t", *fields, some(F.concat(F.lit("E"), "source"))).alias("value"))))


@query("""select o_orderkey, coalesce(case when n = 1 then t end, '') as text from orders left join (select n_chars as k, count(*) as n, min(text) as t
from documents group by n_chars) d on k = o_orderkey % 3000""")
def document_lookup(spark, sf_dir):
    """Queries with the text of their document: none where the document is missing or there are several."""
    q = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3000).alias("doc_id"))
    return readers.with_documents(q, table(spark, sf_dir, "documents").select(F.col("n_chars").alias("doc_id"), "text")).select("o_orderkey", "text")


@query("""with e as (select conv_id, turn * 100 + 7 as place, array_to_string(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[A-Z]')), ' ') as arg, row_number() over (partition by conv_id order by turn, role, text) as r from conversations),
q as (select distinct conv_id, (conv_id % 5) * 100 as beg, 'Zz' as entity from conversations)
select q.conv_id::varchar as query_id, string_agg(arg, ' | ' order by place, arg) as args from q join e on e.conv_id = q.conv_id where r <= 10000 and arg <> '' and abs(beg - place) < 500 and lower(arg) <> lower(entity) group by 1""")
def near_extractions(spark, sf_dir):
    """Proper arguments of the extractions of a document that start near the mention, by offset."""
    c = table(spark, sf_dir, "conversations")
    tokens = F.transform(F.split("text", " ", -1), lambda w: F.struct(w.alias("string"), F.lit(7).alias("start"), w.rlike("^[A-Z]").alias("is_proper")))
    e = c.select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") * 100).alias("sentence_start"), tokens.alias("arg_tokens"), F.struct("turn", "role", "text").alias("ord"))
    q = c.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("query_id"), F.col("conv_id").cast("string").alias("doc_id"), (F.col("conv_id") % 5 * 100).alias("beg"), F.lit("Zz").alias("entity"))
    return readers.extractions_near(q, e).select("query_id", F.array_join("args", " | ").alias("args"))
