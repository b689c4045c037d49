"""Queries over the given tables, one for each operator, and the SQL that states the same.

Stand-ins: documents are mentions, their source and lang stand for system and gold clusters, benchmark items and parts for
a knowledge base. Doubles are rounded to six places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import candidates, evaluate, gazetteer, linkage, linking, nil, surface
from ..sources import store
from . import models
from .registry import query, rounded, table

# Answers: system by source, gold by lang and source.
SYS = "case when doc_id % 3 = 0 then 'NIL' || source else 'E' || source end"
GOLD = "case when doc_id % 5 = 0 then 'NIL' || lang || source when doc_id % 7 = 0 then 'E' || lang when doc_id % 3 = 0 and lang = 'de' then 'NIL' || source else 'E' || source end"
ANSWERS = f"""with a as (select doc_id as query_id, {SYS} as sys, {GOLD} as gold from documents),
n as (select *, count(*) over (partition by sys) as ns, count(*) over (partition by gold) as ng, count(*) over (partition by sys, gold) as nb from a),
o as (select *,
case when sys like 'E%' and gold like 'E%' and sys = gold then 'CORRECT' when sys like 'E%' and gold like 'E%' then 'WRONG KB ID' when gold like 'E%' then 'EXP KB ID' when sys like 'E%' then 'EXP NIL' when ns = nb and ng = nb then 'NIL OK' else 'WRONG NIL ID' end as outcome,
case when case when gold like 'E%' then sys = gold else sys like 'NIL%' end then 1.0::double else 0.0::double end as ok from n)"""


def answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("query_id"), F.expr(SYS).alias("kb_link")), d.select(F.col("doc_id").alias("query_id"), F.expr(GOLD).alias("kb_link"))


@query(ANSWERS + """ select round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f1
from (select avg(ok * nb / ns) as p, avg(ok * nb / ng) as r from o)""")
def b3_scores(spark, sf_dir):
    return rounded(evaluate.b_cubed(*answers(spark, sf_dir)), "precision", "recall", "f1")


@query(ANSWERS + " select query_id, round(ok * nb / ns, 6) as precision, round(ok * nb / ng, 6) as recall from o")
def b3_terms(spark, sf_dir):
    return rounded(evaluate.b_cubed_terms(*answers(spark, sf_dir)), "precision", "recall")


@query(ANSWERS + " select outcome, count(*) as n from o group by outcome")
def outcome_counts(spark, sf_dir):
    return evaluate.outcome_counts(*answers(spark, sf_dir))


@query(ANSWERS + " select count(*) as over_clustered from (select sys from a group by sys having count(distinct gold) > 1)")
def overclustered(spark, sf_dir):
    return evaluate.over_clustered(*answers(spark, sf_dir))


@query(ANSWERS + " select outcome || chr(9) || query_id || chr(9) || sys || case when outcome like '%KB ID%' then chr(9) || 'EXPECTED ' || gold else '' end as line from o")
def benchmark_report(spark, sf_dir):
    return evaluate.report(*answers(spark, sf_dir))


SUMMARY = """, m as (select unnest(['CORRECT','WRONG KB ID','EXP KB ID','EXP NIL','WRONG NIL ID','NIL OK']) as metric) select metric,
round(coalesce(n, 0)::double, 6) as value from m left join (select outcome, count(*) as n from o group by outcome) c on c.outcome = m.metric union all
select 'over_clustered', count(*)::double from (select sys from a group by sys having count(distinct gold) > 1) union all
select unnest(['precision', 'recall', 'f1']), unnest([round(p, 6), round(r, 6), round(2 * p * r / nullif(p + r, 0), 6)])
from (select avg(ok * nb / ns) as p, avg(ok * nb / ng) as r from o)"""


@query(ANSWERS + SUMMARY)
def evaluation_summary(spark, sf_dir):
    return rounded(evaluate.summary(*answers(spark, sf_dir)), "value")


@query("select outcome, count(*) as n, round(avg(case when source <> lang and list_contains(['src1', 'src2', lang], source) then 1 else 0 end), 6) as share from (" + ANSWERS + " select o.outcome, d.source, d.lang from o join documents d on d.doc_id = o.query_id) group by outcome")
def entity_sharing(spark, sf_dir):
    s, g = answers(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("name"), F.col("source").alias("entity"), F.array(F.lit("src1"), F.lit("src2"), "lang").alias("entities"))
    return rounded(evaluate.shared_entities(evaluate.outcomes(s, g).join(d, "query_id")), "share")


SCORED = """with s as (select l.doc_id, l.quality, d.n_chars::double as score from labels l join documents d on d.doc_id = l.doc_id),
r as (select *, row_number() over (order by score desc, doc_id) as rank,
sum(quality) over (order by score desc, doc_id rows unbounded preceding) as positives, count(*) over () as n, sum(quality) over () as p from s)"""


def scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id")


@query(SCORED + """ select doc_id as tie, rank, round(positives / rank, 6) as precision,
round(max(positives / rank) over (order by rank rows between current row and unbounded following), 6) as interpolated,
round((rank - 1) / n, 6) as rank_fraction, round(positives / p, 6) as recall from r""")
def interpolated_pr(spark, sf_dir):
    return rounded(models.interpolated_precision(scored(spark, sf_dir), "quality", "score", "doc_id"), "precision", "interpolated", "rank_fraction", "recall")


@query(SCORED + """ select doc_id as tie, rank, round(positives / rank, 6) as precision,
round(max(positives / rank) over (order by rank rows between current row and unbounded following), 6) as interpolated,
round((rank - 1) / n, 6) as rank_fraction, round(positives / p, 6) as recall from r where quality = 1""")
def positives_pr(spark, sf_dir):
    return rounded(models.interpolated_precision(scored(spark, sf_dir), "quality", "score", "doc_id", positives_only=True), "precision", "interpolated", "rank_fraction", "recall")


@query(SCORED + " select score as threshold, round(2 * positives / (rank + p), 6) as f1 from r order by 2 * positives / (rank + p) desc, rank desc limit 1")
def f1_threshold_sweep(spark, sf_dir):
    return rounded(models.best_threshold(scored(spark, sf_dir), "quality", "score", "doc_id"), "f1")


STOP = ", ".join(f"'{w}'" for w in sim.STOP_WORDS)
TF = f"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from t where term not in ({STOP}) group by doc_id, term)"""


def document_tf(spark, sf_dir):
    return sim.term_frequency(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(TF + " select doc_id, term, tf from tf")
def term_frequency(spark, sf_dir):
    return document_tf(spark, sf_dir)


@query(TF + " select doc_id, term, round(tf / sum(tf) over (partition by doc_id), 6) as rel from tf")
def relative_term_frequency(spark, sf_dir):
    return rounded(sim.relative_frequency(table(spark, sf_dir, "documents"), "doc_id", "text"), "rel")


ITF = f"""with t as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from benchmark),
tf as (select item_id, term, count(*) as tf from t where term not in ({STOP}) group by item_id, term),
nn as (select item_id, sqrt(sum(tf * tf)) as norm from tf group by item_id)"""


@query(ITF + """, d as (select x.item_id as a, y.item_id as b, sum(x.tf * y.tf) as dot from tf x join tf y on x.term = y.term and x.item_id < y.item_id group by 1, 2)
select a, b, round(dot / (n1.norm * n2.norm), 6) as cosine from d join nn n1 on n1.item_id = a join nn n2 on n2.item_id = b""")
def text_cosine_pairs(spark, sf_dir):
    return rounded(sim.cosine_pairs(sim.term_frequency(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id"), "cosine")


@query(TF + """, v as (select doc_id, string_agg(term || ':' || tf, ' ' order by term) as same, sqrt(sum(tf * tf)) as norm from tf group by doc_id),
c as (select same, min(doc_id) as rep from v group by same), r as (select x.doc_id, x.term, x.tf, v.norm from tf x join v using (doc_id) join c on c.rep = x.doc_id),
d as (select x.doc_id as a, y.doc_id as b, sum(x.tf * y.tf) / (any_value(x.norm) * any_value(y.norm)) as cosine from r x join r y on x.term = y.term and x.doc_id < y.doc_id group by 1, 2)
select a, b, round(cosine, 6) as cosine from d where cosine >= 0.8 union all select rep, doc_id, 1.0::double from v join c using (same) where doc_id <> rep""")
def doc_cosine_pairs(spark, sf_dir):
    """Documents at a cosine of 0.8 or more; of those with the same counts the first stands for all, which are paired with it at 1."""
    return rounded(sim.similar_vectors(sim.term_vectors(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", 0.8), "cosine")


@query("""select label, count(*) as n, round(avg(list_cosine_similarity(embedding::double[], c)), 6) as cosine from embeddings
join (select label as l, min_by(embedding, vec_id)::double[] as c from embeddings group by label) on l = label group by label""")
def embedding_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy(F.col("label").alias("l")).agg(F.min_by("embedding", "vec_id").alias("c"))
    return rounded(e.join(first, F.col("label") == F.col("l")).groupBy("label").agg(F.count("*").alias("n"), F.avg(sim.vector_cosine(F.col("embedding"), F.col("c"))).alias("cosine")), "cosine")


MENTION = "select doc_id, text, regexp_extract(text, '[A-Z][a-z]+ [a-z]+') as name from documents where regexp_matches(text, '[A-Z][a-z]+ [a-z]+')"


def mentions(spark, sf_dir):
    """The first name in each text, as a linker's queries name one mention each."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", "[A-Z][a-z]+ [a-z]+", 0).alias("name"))
    return d.where("name <> ''")


@query(f"""with m as ({MENTION}),
w as (select doc_id, string_split_regex(substring(text, greatest(instr(text, name) - 51, 0) + 1, instr(text, name) - 1 + 50 - greatest(instr(text, name) - 51, 0)), '[ \\t\\n\\x0b\\f\\r]+') as w
from m) select doc_id, trim(regexp_replace(array_to_string(w[2:len(w) - 1], ' '), '<[^>]*>', '', 'g')) as context from w""")
def word_context(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", tx.char_context("text", tx.resolved_offset("text", "name", F.lit(-1))).alias("context"))


@query(f"""with m as ({MENTION})
select doc_id, substring(text, greatest(instr(text, name) - 1 - 40, 0) + 1, instr(text, name) - 1 + length(name) + 40 - greatest(instr(text, name) - 1 - 40, 0)) as context
from m""")
def char_context(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", tx.trimmed_context("text", "name").alias("context"))


@query("""with p as (select doc_id, source, lang, trim(regexp_replace(replace(replace(text, '<', ' '), '>', ' '), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as t from documents)
select doc_id, case when doc_id % 3 = 0 then '' else trim(regexp_replace(replace(t, '-', ' '), ' +', ' ', 'g')) end as paragraph, source || ' ' || lang || ' news' as headline from p""")
def document_headline(spark, sf_dir):
    """Headline and first paragraph of newswire text, which is the whole of a document; a third of the documents have no paragraph."""
    body = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<P>\n"), F.translate("text", "<>", "  "), F.lit("\n</P>\n<P>\nSecond.\n</P>")))
    d = table(spark, sf_dir, "documents").select("doc_id", tx.headline_contexts(F.concat(F.lit("<DOC>\n<HEADLINE>\n"), "source", F.lit("-"), "lang", F.lit("\n  news\n</HEADLINE>\n"), body, F.lit("</DOC>"))).alias("c"))
    return d.select("doc_id", F.when(F.size("c") > 1, F.get("c", F.lit(0))).otherwise("").alias("paragraph"), F.element_at("c", -1).alias("headline"))


@query("""with w as (select item_id, string_split(regexp_extract(text, '^[^.\\n]*'), ' ') as w from benchmark),
s as (select item_id, w, unnest(range(1, len(w) + 1)) as i from w),
p as (select item_id, w[2] as name, i, w[i:i + unnest(range(0, len(w) - i + 1))] as x from s) select item_id, array_to_string(x, ' ') as phrase from p
where len(x) > 1 and contains(array_to_string(x, ' '), name)""")
def backoff_strings(spark, sf_dir):
    """Of an entity string, which is a phrase; here the first of each item."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", r"^[^.\n]*", 0).alias("entity"))
    b = b.withColumn("name", F.get(F.split("entity", " "), F.lit(1)))
    return b.where("name is not null").select("item_id", F.explode(tx.backoff_strings("name", "entity")).alias("phrase"))


@query("""select score, count(*) as n,
round(case when score > 0.93 then (trunc(100 * score - 100 * 0.93::double)::double * (20 / ((1 - 0.93::double) * 100)) + 80) / 100 else 0.55 end, 6) as confidence
from (select 1 - l_discount as score from lineitem) group by score""")
def confidence_curve(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy((1 - F.col("l_discount")).alias("score")).agg(F.count("*").alias("n"))
    return rounded(s.withColumn("confidence", tx.confidence("score")), "confidence")


def ordered_names(spark, sf_dir):
    """(pos, p_name): orders as mentions, their names drawn from all parts."""
    part = table(spark, sf_dir, "part")
    return table(spark, sf_dir, "orders").join(part, F.col("p_partkey") == F.col("o_orderkey") % part.count()).select(F.col("o_orderkey").alias("pos"), "p_name")


@query("""with k as (select p_name as title, max(p_partkey) as kb_id from part group by p_name),
l as (select o_orderkey, case when o_orderkey % 2 = 0 then p_name else upper(p_name) end as title from orders join part on p_partkey = o_orderkey % (select count(*) from part))
select l.o_orderkey, l.title, k.kb_id from l left join k on k.title = l.title""")
def kb_exact_link(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("pos") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("name")
    kb = part.select(F.col("p_partkey").alias("kb_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("line_no"))
    out = candidates.exact_title(ordered_names(spark, sf_dir).select(F.col("pos").alias("o_orderkey"), name), "name", kb)
    return out.select("o_orderkey", F.col("name").alias("title"), "kb_id")


@query("""with n as (select distinct n_name as name from nation union select distinct string_split(p_name, ' ')[1] from part)
select name, count(distinct p_partkey) as n_titles from n left join part on contains(lower(p_name), lower(name)) group by name""")
def kb_contains_ambiguity(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(part.select(F.get(F.split("p_name", " "), F.lit(0))))
    return candidates.ambiguity(names, "name", part.select(F.col("p_partkey").alias("kb_id"), F.col("p_name").alias("title")))


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)")
def passage_link(spark, sf_dir):
    return linking.passage_links(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""with a as (select p_name as surface, l_suppkey as kb_name, count(*) as n from lineitem join part on p_partkey = l_partkey group by 1, 2),
s as (select surface, kb_name, n / sum(n) over (partition by surface) as p from a) select surface, kb_name, round(p, 6) as candidate_score,
row_number() over (partition by surface order by p desc, kb_name) as rank from s""")
def candidate_ranking(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_name").alias("surface"), F.col("l_suppkey").alias("kb_name")).agg(F.count("*").alias("n"))
    return rounded(candidates.ranked(candidates.anchor_priors(a), ["surface"], "candidate_score"), "candidate_score")


@query("""select doc_id, lang, case when used > 0 then 'NIL' || case when n < 10000 then lpad(n::varchar, 4, '0') else n::varchar end end as nil_id
from (select doc_id, lang, used, sum(used) over (order by doc_id rows unbounded preceding)::bigint - 1 as n from (select doc_id, lang,
case when doc_id % 4 = 0 then 0 when doc_id % 5 = 0 then 2 else 1 end as used from documents))""")
def nil_allocate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").alias("pos"), F.expr("case when doc_id % 4 = 0 then 0 when doc_id % 5 = 0 then 2 else 1 end").alias("consumed"))
    return nil.allocate(d).select("doc_id", "lang", "nil_id")


NILS = """select doc_id as pos, doc_id as query_id, case when doc_id % 3 = 0 then text else source end as name, text as entity,
case when doc_id % 4 = 0 then 'E' else 'NIL' end || doc_id as kb_link, 0.55::double as confidence from documents"""


@query(f"""with a as ({NILS}),
k as (select entity, min_by(kb_link, pos) as f from a where kb_link like 'NIL%' and entity <> name group by entity)
select pos, query_id, name, a.entity, case when kb_link like 'NIL%' and f is not null then f else kb_link end as kb_link,
case when kb_link like 'NIL%' and f is not null then 0.6 else confidence end as confidence from a left join k on k.entity = a.entity""")
def nil_exact_cluster(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id as pos", "doc_id as query_id", "case when doc_id % 3 = 0 then text else source end as name", "text as entity", "case when doc_id % 4 = 0 then 'E' else 'NIL' end || doc_id as kb_link", "0.55D as confidence")
    return nil.cluster_exact(d)


@query("select r_name as container, 'region' as kind, list_sort(list(distinct n_name)) as cities from nation join region on r_regionkey = n_regionkey group by r_name")
def gazetteer_containment(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return gazetteer.containment(j.select(F.col("r_name").alias("container"), F.col("n_name").alias("city"), F.lit("region").alias("kind")))


@query("""select c_custkey, n_name, coalesce(n_regionkey < 2, false) as is_city, coalesce(n_regionkey = 2, false) as is_state,
coalesce(n_regionkey > 2, false) as is_country from customer join nation on n_nationkey = c_nationkey where c_custkey % 2 = 0 or n_regionkey >= 0""")
def gazetteer_flags(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    kinds = n.select(F.lower("n_name").alias("name_lc"), F.when(F.col("n_regionkey") < 2, "city").when(F.col("n_regionkey") == 2, "state").otherwise("country").alias("kind"))
    named = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    return gazetteer.place_flags(named, "n_name", kinds)


@query("select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey where lower(n_name) in (select lower(n_name) from nation where n_regionkey = 1)")
def gazetteer_semi(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    named = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    return gazetteer.known_places(named, "n_name", n.where("n_regionkey = 1").select(F.lower("n_name").alias("name_lc")))


W = models.SPORTS_WEIGHTS


@query(f"""with m as ({MENTION}), f as (select doc_id, name, text as c, instr(text, name) - 1 as pos from m),
g as (select *, greatest(pos - 30, 0) as lo, instr(substring(c, greatest(pos - 30, 0) + 1), ' in ') as fnd from f),
h as (select doc_id, case when pos >= 0 and fnd > 0 and lo + fnd - 1 < pos then least(30.0, (pos - (lo + fnd - 1))::double) else 30.0::double end as in_proximity,
  case when len(string_split(c, ' ')) >= 10 then 1.0::double else 0.0::double end as context_length,
  floor(len(regexp_extract_all(c, '\\s[0-9]{{1,2}}-[0-9]{{1,2}}')) / greatest(length(c), 1)) as score_pattern,
  (doc_id % 10) / 10.0::double as text_score, (doc_id % 3)::double as organizations_with_locations, (doc_id % 2)::double as context_has_full_location,
  (doc_id % 4 = 0)::int as ner_location, (doc_id % 4 = 1)::int as ner_none, (doc_id % 4 = 2)::int as ner_organization, (doc_id % 4 = 3)::int as ner_person from g),
p as (select *, 1 / (1 + exp(-({' + '.join(f"({W[k]!r})::double * {k}" for k in W)}))) as p from h)
select doc_id, in_proximity, context_length, round(p, 6) as p, case when doc_id % 4 <> 3 then p > 0.15 end as sports from p""")
def sports_linear_score(spark, sf_dir):
    """The sports sense by all ten features, and its label: none for people."""
    m = mentions(spark, sf_dir).select("doc_id", "name", F.col("text").alias("c"))
    ner = F.element_at(F.array(*map(F.lit, ("LOCATION", "None", "ORGANIZATION", "PERSON"))), (F.col("doc_id") % 4 + 1).cast("int"))
    f = models.sports_features(F.col("c"), F.col("name"), ner, (F.col("doc_id") % 10) / 10.0, (F.col("doc_id") % 3).cast("double"), (F.col("doc_id") % 2).cast("double"))
    p = candidates.logistic(models.SPORTS_WEIGHTS, f, models.SPORTS_INTERCEPT)
    label = models.sports_sense(ner != "PERSON", p)
    return m.select("doc_id", f["in_proximity"].alias("in_proximity"), f["context_length"].alias("context_length"), F.round(p, 6).alias("p"), label.alias("sports"))


@query("""with b as (select *, case when lag(role) over w is distinct from role then 1 else 0 end as brk from conversations window w as (partition by conv_id
order by turn, role, text)),
i as (select *, sum(brk) over (partition by conv_id order by turn, role, text rows unbounded preceding) as island from b)
select conv_id, island::bigint as island, min(role) as role, count(*) as n, min(turn) as first_turn, max(turn) as last_turn from i
group by conv_id, island""")
def entity_merge_gaps(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, sf_dir, "conversations").withColumn("brk", (~F.lag("role").over(w).eqNullSafe(F.col("role"))).cast("int"))
    c = c.withColumn("island", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("""select event_id, max(case when event_type = 'view' then event_id end) over (partition by user_id
order by event_id rows between unbounded preceding and 1 preceding) as nearest_view from events""")
def nearest_preceding(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(w).alias("nearest_view"))


NAMES = "with n as (select distinct p_name as name from part)"


def name_pairs(spark, sf_dir):
    """All pairs of distinct names: what is asked for grows with the square of their number, which the list of products bounds and not the rows."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return n.toDF("a").join(n.toDF("b"), F.expr("a < b"))


@query(NAMES + " select x.name as a, y.name as b, round(jaro_winkler_similarity(x.name, y.name), 6) as jw from n x join n y on x.name < y.name")
def jaro_winkler_pairs(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("a", "b", F.round(sim.jaro_winkler("a", "b"), 6).alias("jw"))


ABBR = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1))), '')"
PAIR = NAMES + f""", f as (select x.name as a, y.name as b, (case when {ABBR.format(x='x.name')} = upper(y.name) or {ABBR.format(x='y.name')} = upper(x.name) then 1.0 else 0.0 end)::double as abbreviation, (case when contains(lower(x.name), lower(y.name)) or contains(lower(y.name), lower(x.name)) then 1.0 else 0.0 end)::double as contains, (case when starts_with(lower(x.name), lower(y.name)) or starts_with(lower(y.name), lower(x.name)) then 1.0 else 0.0 end)::double as prefix, jaro_winkler_similarity(x.name, y.name) as jw
from n x join n y on x.name < y.name)"""


@query(PAIR + """ select a, b, abbreviation, contains, prefix, 0.0::double as common_surname from f union all
select name, upper(name), (upper(left(name, 1)) || upper(left(string_split(name, ' ')[2], 1)) = upper(name))::int::double, 1.0, 1.0, starts_with(name, 'red')::int::double
from n""")
def pair_features(spark, sf_dir):
    """Features of all pairs of distinct names, and of each name with its capitals, of which those on a list of surnames count as such."""
    both = name_pairs(spark, sf_dir)
    own = both.select("a").union(both.select("b")).distinct()
    surnames = [r[0] for r in own.where("a like 'red%'").collect()]  # a list of surnames is given as a file of a few thousand
    both = both.union(own.select("a", F.upper("a")))
    f = sim.name_features(F.col("a"), F.col("b"), surnames)
    return both.select("a", "b", *[c.alias(k) for k, c in f.items()])


@query(PAIR + " select a, b, round(1 / (1 + exp(-(0.5 * abbreviation + 1.5 * contains + 2.0 * prefix + 4.0 * jw - 3.0))), 6) as p from f")
def pair_score(spark, sf_dir):
    f = sim.name_features(F.col("a"), F.col("b")) | {"jw": sim.jaro_winkler("a", "b")}
    return name_pairs(spark, sf_dir).select("a", "b", F.round(candidates.logistic({"abbreviation": 0.5, "contains": 1.5, "prefix": 2.0, "jw": 4.0}, f, -3.0), 6).alias("p"))


@query()
def average_link_clusters(spark, sf_dir):
    """Embeddings of a label as mentions, each a NIL of its own, down to a mean cosine of 0.5; clusters meet within a label only."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    id_ = F.col("vec_id").cast("string")
    return linkage.average_link(e.select(id_.alias("query_id"), F.concat(F.lit("NIL"), F.lpad(id_, 8, "0")).alias("kb_link"), "label", "embedding"), 0.5, "label")


@query("""with l as (select *, doc_id % 8 as fold from labels),
tr as (select doc_id from l where fold <> 0),
te as (select doc_id from l where fold = 0) select 'train' as part, count(*) as n from tr union all select 'test', count(*) from te union all
select 'both', count(*) from (select * from tr intersect select * from te) union all select 'bag', count(*) from (select * from tr union all select *
from te union all select * from te) union all select 'set', count(*) from (select * from tr union select * from te union select * from te) union all
select 'rest', count(*) from (select doc_id from l except select * from te)""")
def set_ops_train_test(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 8).alias("fold"))
    train, test = rows.where("fold <> 0").select("doc_id"), rows.where("fold = 0").select("doc_id")
    sets = {"train": train, "test": test, "both": train.intersect(test), "bag": train.union(test).union(test), "set": train.union(test).union(test).distinct(), "rest": rows.select("doc_id").subtract(test)}
    out = None
    for k, d in sets.items():
        one = d.agg(F.lit(k).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("select quality, toxic, count(*) as n, round(avg(case when quality = 1 - toxic then 1 else 0 end), 6) as accuracy from labels group by quality, toxic")
def class_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("int")), 6).alias("accuracy"))


@query("""select doc_id % 8 as fold, count(*) as n, round(avg(case when (n_chars > 200) = (quality = 1) then 1 else 0 end), 6) as accuracy
from (select l.doc_id, l.quality, d.n_chars from labels l join documents d on d.doc_id = l.doc_id) group by 1""")
def kfold_accuracy(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy((F.col("doc_id") % 8).alias("fold")).agg(F.count("*").alias("n"), F.round(F.avg(((F.col("n_chars") > 200) == (F.col("quality") == 1)).cast("int")), 6).alias("accuracy"))


@query()
def cross_validation(spark, sf_dir):
    """Eight folds of a logistic regression of quality on lengths."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    f = j.select("doc_id", "quality", F.log1p("n_chars").alias("chars"), (F.size(F.split("text", "\n")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("lines"))
    return models.cross_validate(f, ["chars", "lines"], "quality", "doc_id")


@query("""select doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: case when contains(w, '.') then w when starts_with(lower(w), 'ß') then lower(w) else upper(substring(w, 1, 1)) || lower(substring(w, 2)) end), ' ') as cased
from documents""")
def location_casing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.location_casing("text").alias("cased"))


@query(f"with m as ({MENTION}) select doc_id, ((length(text) - length(replace(text, name, ''))) / length(name))::bigint as n, instr(text, name) - 1 as first from m")
def name_occurrences(spark, sf_dir):
    m = mentions(spark, sf_dir).select("doc_id", tx.occurrences("text", "name").alias("at")).where(F.size("at") > 0)
    return m.select("doc_id", F.size("at").cast("long").alias("n"), F.get("at", F.lit(0)).cast("long").alias("first"))


#: Eight kinds of mentions by order: over the threshold, the same but unknown to the knowledge base, the exact title, a
#: back-off string, nothing, no annotation, and a location with the sports sense with and without a team.
LINKED = """with k as (select p_name as title, max(p_partkey) as kb_id, length(p_name) % 2 = 0 as is_city from part group by 1),
q as (select o_orderkey as pos, o_orderkey % 8 as kind, p_name from orders join part on p_partkey = o_orderkey % (select count(*) from part)),
d as (select q.*, case when kind in (1, 4, 5) or kind = 7 and is_city then null when kind = 6 and is_city then 'T' || kb_id else 'E' || kb_id end as kb_id, is_city from q join k on k.title = q.p_name),
r as (select *, sum(case when kb_id is null then 1 else 0 end) over (order by pos rows unbounded preceding)::bigint - 1 as n from d)"""


@query(LINKED + """ select pos, case when kind in (2, 3) then string_split(p_name, ' ')[1] else p_name end as name, p_name as entity,
coalesce(kb_id, 'NIL' || case when n < 10000 then lpad(n::varchar, 4, '0') else n::varchar end) as kb_link,
round(case when kind = 5 then 0.1 when kind = 4 then 0.55 when kind = 2 then 0.8 when kind in (6, 7) and is_city then case when kind = 6 then 0.7 else 0.5 end when kind = 3 then (2 * 20 / 7.0::double + 80) / 100 else (4 * 20 / 7.0::double + 80) / 100 end::double, 6) as confidence,
case kind when 5 then 'error' when 4 then 'none' when 2 then 'title' when 3 then 'backoff' else 'candidate' end as path from r""")
def link_cascade(spark, sf_dir):
    """Every path of the cascade, and the move from a place to its team."""
    part = table(spark, sf_dir, "part")
    kind = F.col("pos") % 8
    q = ordered_names(spark, sf_dir).withColumns({"kind": kind, "query_id": F.col("pos").cast("string"), "word": F.get(F.split("p_name", " "), F.lit(0))})
    m = q.select(
        "pos", "query_id", F.when(F.col("kind").isin(2, 3), F.col("word")).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("kind") == 3, F.concat(F.lit("The "), "p_name", F.lit(" Works"))).otherwise(F.col("p_name")).alias("entity"),
        (F.col("kind") >= 6).alias("sports"), F.when(F.col("kind") == 5, "no annotation").alias("error_reason"),
    )
    score = F.when(F.col("kind").isin(2, 4), 0.3).when(F.col("kind") == 3, 0.95).otherwise(0.97)
    top = F.when(F.col("kind") == 1, F.concat("p_name", F.lit(" (unknown)"))).otherwise(F.col("p_name"))
    c = q.select("query_id", F.col("p_name").alias("surface"), top.alias("kb_name"), score.alias("score"), F.lit(1).alias("rank"))
    c = c.union(q.where("kind = 6").select("query_id", "p_name", F.concat("p_name", F.lit(" FC")), F.lit(0.94), F.lit(2)))
    places = F.when(F.length("p_name") % 2 == 0, "City of the region").otherwise("person")
    kb = part.select(F.concat(F.lit("E"), "p_partkey").alias("kb_id"), F.col("p_name").alias("title"), places.alias("wiki_type"), F.lit("").alias("structured_type"), F.col("p_partkey").alias("line_no"))
    kb = kb.union(part.select(F.concat(F.lit("T"), "p_partkey"), F.concat("p_name", F.lit(" FC")), F.lit("Football club"), F.lit("ORG"), "p_partkey"))
    return rounded(linking.link(m, c, kb), "confidence").select("pos", "name", "entity", "kb_link", "confidence", "path")


PLACES = """with n as (select n_nationkey, upper(n_name[1]) || lower(n_name[2:]) as city, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as region from nation join region on r_regionkey = n_regionkey)"""


@query(PLACES + """ select c_custkey, case c_custkey % 10 when 0 then 'UNB' when 1 then 'Ford' when 4 then 'Acme' when 5 then 'Acme' when 6 then 'Bank' when 9 then 'NB' else city end as name,
case c_custkey % 10 when 0 then 'United Northern Bank' when 1 then 'Gerald Ford' when 2 then city || ', ' || region when 3 then case when contains(region, ' ') then city else city || ', ' || region end
  when 4 then 'The Acme Group' when 5 then 'Acme' when 6 then 'Bankers' when 7 then city || ', ' || region when 8 then 'Gerald ' || city else city || ' of Bank' end as entity, case when c_custkey % 20 = 5 then 'no annotation' when c_custkey % 10 = 5 then 'unknown entity type' end as error_reason
from customer join n on n_nationkey = c_nationkey""")
def surface_rules(spark, sf_dir):
    """A mention for each rule: initials, a longer name, a container among the places and in the text, the chain, a longer word, what no rule
    takes, a longer place with its container, a person who stands alone in the text, and an acronym behind its expansion."""
    cased = lambda c: tx.location_casing(c)
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", cased("n_name").alias("city"), cased("r_name").alias("region"))
    within = {r["region"]: frozenset(r["cities"]) for r in n.groupBy("region").agg(F.collect_set("city").alias("cities")).collect()}
    gaz = surface.Gazetteer(frozenset(x.lower() for c in within.values() for x in c), frozenset(), frozenset(x.lower() for x in within), within)
    m = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).withColumn("kind", F.col("c_custkey") % 10)
    by = lambda other, **cases: F.coalesce(*[F.when(F.col("kind") == int(k[1:]), v) for k, v in cases.items()], other)
    strings = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]).cast("array<string>")
    city, region = F.col("city"), F.col("region")
    m = m.select(
        "c_custkey", by(city, k0=F.lit("UNB"), k1=F.lit("Ford"), k4=F.lit("Acme"), k5=F.lit("Acme"), k6=F.lit("Bank"), k9=F.lit("NB")).alias("name"),
        by(F.lit("The Acme Group grew. It is Acme."), k0=F.lit("The United Northern Bank (UNB) grew."), k1=F.lit("Gerald Ford spoke. Then Ford left."), k2=F.concat(F.lit("From "), region, F.lit(" he went to "), city), k3=F.concat(F.lit("He saw "), city, F.lit(", "), region, F.lit(".")), k6=F.lit("Bankers met at the Bank"),
           k7=F.concat(F.lit("He lives in "), city), k8=F.concat(F.lit("He met Gerald "), city, F.lit(" in town.")), k9=F.concat(F.lit("The "), city, F.lit(" of Bank (NB) grew."))).alias("text"),
        F.when(F.col("c_custkey") % 20 == 5, F.lit(None)).otherwise(by(F.lit("None"), k0=F.lit("ORGANIZATION"), k1=F.lit("PERSON"), k2=F.lit("LOCATION"), k3=F.lit("LOCATION"), k5=F.lit("DATE"), k6=F.lit("ORGANIZATION"), k7=F.lit("LOCATION"), k8=F.lit("PERSON"), k9=F.lit("ORGANIZATION"))).alias("ner_type"),
        by(strings(), k0=strings("Acme", "United Northern Bank"), k6=strings("Bankers")).alias("orgs"), by(strings(), k2=strings(region, city), k7=strings(F.concat(city, F.lit(" in "), region))).alias("locs"), by(strings(), k1=strings("Ann Lee", "Gerald Ford")).alias("people"),
        by(strings(), k4=strings("The Acme Group", "The Acme Group of Companies")).alias("matching"),
        F.when(F.col("kind") == 4, F.array(F.struct(F.lit(0).alias("start"), F.lit(13).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.lit(None).cast("boolean").alias("sports"),
    )
    m = m.withColumn("beg", F.length("text") - F.instr(F.reverse("text"), F.reverse("name")) - F.length("name") + 1)
    return surface.entity_strings(m, gaz).select("c_custkey", "name", "entity", "error_reason")


@query()
def entity_surface_rules(spark, sf_dir):
    """Mentions of documents expanded by the surface rules, with runs of capital words for entities."""
    m = mentions(spark, sf_dir)
    caps = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1)))
    none = F.array().cast("array<string>")
    m = m.select("doc_id", F.element_at(F.split("name", " "), 1).alias("name"), "text", F.lit("ORGANIZATION").alias("ner_type"), caps.alias("orgs"), none.alias("locs"), caps.alias("people"), none.alias("matching"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("boolean").alias("sports"))
    m = m.withColumn("beg", tx.resolved_offset("text", "name", F.lit(-1)))
    return surface.entity_strings(m, surface.Gazetteer()).select("doc_id", "name", "entity", "error_reason")


PASSAGES = """with h as (select doc_id, min(item_id) as item from documents d join benchmark b on b.text <> '' and contains(d.text, b.text) group by doc_id),
a as (select doc_id as query_id, coalesce('E' || lpad(item::varchar, 7, '0'), 'NIL' || dense_rank() over (order by text)) as sys, coalesce('E' || lpad(item::varchar, 7, '0'), 'NIL' || md5(text)) as gold from documents left join h using (doc_id))"""


@query(PASSAGES + ANSWERS[ANSWERS.index("n as (") - 2 :] + SUMMARY)
def passage_link_evaluation(spark, sf_dir):
    """Documents linked to the benchmark passage they hold, the rest clustered by text, against the same clusters: the flagship."""
    d = table(spark, sf_dir, "documents")
    root = store.folder(spark)
    held = linking.passage_links(d, table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.min("item_id").alias("item"))
    # Texts are only told apart from here on, so their hashes stand for them: no text is numbered, sorted or shuffled.
    marks = d.select("doc_id", F.sha2("source", 256).alias("name"), F.sha2("text", 256).alias("entity"), F.md5("text").alias("md5"))
    base = marks.join(held, "doc_id", "left").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("query_id"), "name", "entity", "md5", F.concat(F.lit("E"), F.lpad(F.col("item").cast("string"), 7, "0")).alias("kb"))
    base = store.written(base, root, "base")
    ids = nil.allocate(base.withColumn("consumed", F.col("kb").isNull().cast("int")))
    linked = nil.cluster_exact(ids.select("pos", "query_id", "name", "entity", F.coalesce("kb", "nil_id").alias("kb_link"), F.lit(0.55).alias("confidence")))
    linked = store.written(linked.select("query_id", "kb_link"), root, "linked")
    gold = base.select("query_id", F.coalesce("kb", F.concat(F.lit("NIL"), "md5")).alias("kb_link"))
    return rounded(evaluate.summary(linked, gold), "value")
