"""Queries over saved models and the index of aliases, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aliases, bayes, candidates
from ..sources import readers, store, writers
from . import learning
from .files import written
from .registry import query, rounded, table

#: Weights of the link classifier in the file that the query writes and reads.
WEIGHTS, INTERCEPT = {"candidate_score": 4.0, "docsim": 2.0}, -2.5

#: Names of clients as aliases of their masters, and the same names as they are written with one or two edits.
ALIASES = f"""with c as (select client_id, coalesce('E' || master_id, 'none') as kb_name, regexp_replace(name, '[^ -~]', '?', 'g') as name from clients where length(name) > 2),
e as (select *, client_id % 4 as kind, (client_id % (length(name) - 1))::int + 1 as p from c),
w as (select distinct case kind when 0 then name when 1 then left(name, p - 1) || substring(name, p + 1) when 2 then left(name, p - 1) || 'x' || substring(name, p)
  else left(name, p - 1) || 'x' || substring(name, p + 1) end || case when client_id % 8 > 3 then 'q' else '' end as string from e),
a as (select name as surface, kb_name, count(*) as n from c group by all),
s as (select *, n / sum(n) over (partition by surface) as prior from a),
m as (select string, surface, levenshtein(string, surface) as edits from w join (select distinct surface from a) on abs(length(string) - length(surface)) <= 2
  where levenshtein(string, surface) <= case when length(string) >= 9 then 2 when length(string) >= 5 then 1 else 0 end),
r as (select string, surface, kb_name, edits, prior * (1 - edits / greatest(length(string), length(surface))) as candidate_score from m join s using (surface)),
b as (select * from r qualify row_number() over (partition by string, kb_name order by candidate_score desc, edits, surface) = 1),
k as (select * from b qualify row_number() over (partition by string order by candidate_score desc, kb_name) <= 10),
d as (select *, len(list_intersect(string_split(string, ' '), string_split(surface, ' '))) / len(list_distinct(list_concat(string_split(string, ' '), string_split(surface, ' ')))) as docsim from k),
f as (select *, 1 / (1 + exp(-({INTERCEPT}::double + candidate_score * {WEIGHTS['candidate_score']}::double + docsim * {WEIGHTS['docsim']}::double))) as score from d)"""


@query(ALIASES + """ select string, surface, kb_name, edits::int as edits, round(candidate_score, 6) as candidate_score, round(score, 6) as score,
row_number() over (partition by string order by score desc, kb_name)::int as rank from f""")
def alias_candidates(spark, sf_dir):
    """The ten best entities of each misspelt name, ranked by a link classifier that is read from its file. The words that name and alias share stand for the similarity of their contexts."""
    c = table(spark, sf_dir, "clients").where(F.length("name") > 2)
    c = c.select("client_id", F.coalesce(F.concat(F.lit("E"), "master_id"), F.lit("none")).alias("kb_name"), F.regexp_replace("name", "[^ -~]", "?").alias("name"))
    c = c.withColumns({"kind": F.col("client_id") % 4, "p": (F.col("client_id") % (F.length("name") - 1)).cast("int") + 1})
    before, at, after = F.expr("left(name, p - 1)"), F.expr("substring(name, p)"), F.expr("substring(name, p + 1)")
    string = F.when(F.col("kind") == 0, F.col("name")).when(F.col("kind") == 1, F.concat(before, after)).when(F.col("kind") == 2, F.concat(before, F.lit("x"), at)).otherwise(F.concat(before, F.lit("x"), after))
    names = c.select(F.concat(string, F.when(F.col("client_id") % 8 > 3, "q").otherwise("")).alias("string")).distinct()
    root = store.folder(spark)
    anchors = c.groupBy(F.col("name").alias("surface"), "kb_name").agg(F.count("*").alias("n"))
    priors = store.written(candidates.anchor_priors(anchors), root, "priors")
    k = aliases.top_candidates(names, "string", priors).drop("rank")
    own, theirs = F.split("string", " "), F.split("surface", " ")
    k = k.withColumn("docsim", F.size(F.array_intersect(own, theirs)) / F.size(F.array_union(own, theirs)))
    weights, intercept = readers.linear_model(spark, written(spark, writers.linear_model_lines(spark, WEIGHTS, INTERCEPT)))
    out = candidates.ranked(learning.scored_by(k, weights, intercept), ["string"], "score")
    return rounded(out.select("string", "surface", "kb_name", F.col("edits").cast("int").alias("edits"), "candidate_score", "score", "rank"), "candidate_score", "score")


@query(f"""with d as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as t from documents),
w as (select doc_id, term, count(*) / any_value(n) as weight from (select doc_id, len(t) as n, unnest(t) as term from d) group by doc_id, term),
x as (select w.*, quality as label from w join labels using (doc_id) where quality is not null),
c as (select term, coalesce(sum(weight) filter (label = 0), 0) as no, coalesce(sum(weight) filter (label = 1), 0) as yes from x group by term),
n as (select count(*) filter (quality = 0) as no, count(*) filter (quality = 1) as yes from labels join documents using (doc_id)),
s as (select sum(no) as no, sum(yes) as yes, count(*) as size from c), z as (select {bayes.SMOOTHING}::double as a),
o as (select term, ln((c.yes + a) / (s.yes + a * size)) as yes, ln((c.no + a) / (s.no + a * size)) as no from c, s, z),
l as (select doc_id, sum(weight * yes) as yes, sum(weight * no) as no from w join o using (term) group by doc_id),
p as (select ln((n.yes + a) / (n.yes + n.no + 2 * a)) as yes, ln((n.no + a) / (n.yes + n.no + 2 * a)) as no from n, z)
select doc_id, round(p.yes + coalesce(l.yes, 0), 6) as text_log, round(1 / (1 + exp(p.no + coalesce(l.no, 0) - p.yes - coalesce(l.yes, 0))), 6) as text_score
from d left join l using (doc_id), p""")
def text_model(spark, sf_dir):
    """A naive Bayes model of the labelled documents, kept as a table and read again, over all documents."""
    root = store.folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("terms")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = d.join(F.broadcast(labels) if store.small(labels) else labels, "doc_id").select("doc_id", "label", terms)
    bayes.save(bayes.train(rows, "doc_id", "terms", "label"), f"{root}/model")
    d = d.select("doc_id", terms)
    out = bayes.scored(d, "doc_id", "terms", bayes.load(spark, f"{root}/model"))
    return rounded(out.select("doc_id", "text_log", "text_score"), "text_log", "text_score")
