"""Queries over contexts, knowledge-base texts, places and link features, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import candidates, gazetteer
from .registry import query, rounded, table


def cat(*parts):
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


@query("""select doc_id,
case doc_id % 3 when 0 then 'Beta ' || lang || doc_id || ' two.' when 1 then 'Gamma ' || lang || doc_id || ' here.' else 'bbb Mr. Z' || doc_id || ' ccc' end as context
from documents""")
def context_cascade(spark, sf_dir):
    """The sentence of the paragraph, else of what tags bound, else the words round the mention."""
    d = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 3
    name = F.when(kind == 2, cat("Mr. Z", "$doc_id")).otherwise(cat("$lang", "$doc_id"))
    text = F.when(kind == 0, cat("<DOC> <P>Alpha ", "$source", " one. Beta\n ", "$lang", "$doc_id", "  two. Then\n</P> tail"))
    text = text.when(kind == 1, cat("<x>No. Before</x><b>Gamma ", "$lang", "$doc_id", " here. Delta.</b>")).otherwise(cat("aaa bbb Mr. Z", "$doc_id", " ccc ddd"))
    return d.select("doc_id", tx.context(text, name, F.lit(-1)).alias("context"))


@query("""with p as (select page_id, html, instr(html, '<p>') + 12 as b from pages)
select page_id, trim(regexp_replace(regexp_extract(substring(html, 1, b), '([^>]*)$', 1) || regexp_extract(substring(html, b + 1), '^([^<]*)', 1), '\\s+', ' ', 'g')) as context from p""")
def wide_context(spark, sf_dir):
    at = F.expr("0") + F.instr("html", "<p>") + 12
    return table(spark, sf_dir, "pages").select("page_id", tx.wide_context("html", F.lit("x"), at).alias("context"))


@query("select doc_id, case when doc_id % 2 = 0 then 'news of ' || lang || '|' else '' end || 'about ' || source || '|more' as contexts from documents")
def all_mention_contexts(spark, sf_dir):
    """Distinct contexts of a mention's chain, after what the headline adds."""
    d = table(spark, sf_dir, "documents")
    own = F.array(cat("about ", "$source"), F.lit("more"), cat("about ", "$source"))
    headline = F.when(F.col("doc_id") % 2 == 0, F.array(cat("news of ", "$lang"))).otherwise(F.array(F.col("source")))
    return d.select("doc_id", F.array_join(tx.mention_contexts(own, headline), "|").alias("contexts"))


@query("""select doc_id, case when not regexp_matches(text, '[.!?](\\s|$)') then substring(text, 1, 100)
else coalesce(nullif(regexp_extract(text, '(?s)^(.*?[.!?])(\\s[^a-z]|\\s$|$)', 1), ''), text) end as intro from documents""")
def kb_intro(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.intro("text").alias("intro"))


@query("""with p as (select doc_id, unnest(string_split(text, chr(10))[2:]) as p, generate_subscripts(string_split(text, chr(10))[2:], 1) as i from documents),
k as (select *, len(string_split_regex(p, '\\s+')) as n from p), r as (select *, coalesce(sum(n) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as before from k where n > 7)
select d.doc_id, coalesce(string_agg(p, ' ' order by i) filter (before < 1500), '') as paragraphs from documents d left join r on r.doc_id = d.doc_id group by d.doc_id""")
def kb_first_paragraphs(spark, sf_dir):
    """Lines as paragraphs, but the first, up to 1500 words."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("paragraphs"))


STATES = "(values " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(gazetteer.STATES.items())) + ") as s(i, code, state)"


@query(f"""select p_partkey,
case when p_partkey % 3 = 0 then p_name when p_partkey % 60 >= 50 then p_name || ', zz' else string_split(p_name, ' ')[-1] || ', ' || state end as place,
case when p_partkey % 3 <> 1 then null when p_partkey % 60 < 50 then (select min(t.state) from {STATES.replace('as s(', 'as t(')}
where starts_with(t.state, substring(s.state, 1, 4))) end as expanded from part left join {STATES} on i = p_partkey % 60""")
def state_expansion(spark, sf_dir):
    """City and postal code to city and state, and the beginning of a state's name to the state."""
    states = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(gazetteer.STATES.items())], "i int, code string, state string")
    p = table(spark, sf_dir, "part").join(states, F.col("i") == F.col("p_partkey") % 60, "left")
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.left("code", F.lit(1)), F.lit("."), F.lower(F.right("code", F.lit(1))), F.lit("."))).otherwise(F.col("code"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(", ", "p_name", F.coalesce(code, F.lit("zz"))))
    short = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.left("state", F.lit(4)), F.lit(".")))
    p = p.select("p_partkey", gazetteer.expand_state(text).alias("place"), short.alias("short"))
    return gazetteer.expand_prefix(p, "short", states.select("state")).select("p_partkey", "place", "expanded")


@query("""select c_custkey, n_name, r_name, n_regionkey = r_regionkey as held, (n_regionkey < 2) = (r_regionkey < 2) and (n_regionkey = 2) = (r_regionkey = 2) as same_kind
from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = c_custkey % 5""")
def place_pairs(spark, sf_dir):
    """Pairs of places: whether the gazetteer has one in the other, and whether both are of one kind."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kind = lambda c: F.when(F.col(c) < 2, "city").when(F.col(c) == 2, "state").otherwise("country")
    places = n.select(F.lower("n_name").alias("name_lc"), kind("n_regionkey").alias("kind")).union(r.select(F.lower("r_name"), kind("r_regionkey")))
    pairs = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("c_custkey") % 5).select("c_custkey", "n_name", "r_name")
    flags = gazetteer.place_flags(pairs, "n_name", places).withColumnsRenamed({f"is_{k}": f"a_{k}" for k in ("city", "state", "country")})
    flags = gazetteer.place_flags(flags, "r_name", places).withColumnsRenamed({f"is_{k}": f"b_{k}" for k in ("city", "state", "country")})
    city_in = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("container"), F.col("n_name").alias("city"))
    held = gazetteer.in_container(pairs.select("c_custkey", F.col("r_name").alias("container"), F.col("n_name").alias("city")), city_in).select("c_custkey", F.lit(True).alias("held"))
    return flags.join(held, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("held", F.lit(False)).alias("held"), gazetteer.same_kind("a", "b").alias("same_kind"))


LINK_SQL = """with f as (select doc_id, source as name, case when doc_id % 4 = 0 then source else lang || ' ' || source end as entity, case when doc_id % 3 = 0 then 'eng-' else 'x-' end || doc_id as doc, regexp_extract_all(text, '[A-Z][a-z]+') as w, text from documents),
g as (select *, case when doc_id % 5 = 0 then name when doc_id % 5 = 1 then entity else coalesce(w[2], 'None') end as kb_name, list_distinct(w[1:6]) as s, list_distinct(w[5:9]) as k from f),
h as (select *, list_filter(s, lambda x: not contains(x, kb_name)) as other from g)"""


@query(LINK_SQL + """ select doc_id, (doc_id % 10) / 10.0::double as candidate_score, (doc_id % 7) / 7.0::double as docsim, case when doc_id % 50 > 0 then round(ln(doc_id % 50), 6) else 0.0 end as log_inlinks,
(name = kb_name)::int::double as original_name_match, (entity = kb_name)::int::double as full_name_match, (entity <> name)::int::double as full_name_found, (doc_id % 3 = 0)::int::double as is_web_document,
5.0::double as coref_context_length, len(string_split(entity, ' '))::double as full_name_length, 1.0::double as original_name_length, (len(list_intersect(other, k)) > 0)::int::double as entity_overlap,
round(case when len(other) > 0 then len(list_intersect(other, k)) / len(other) else 0 end, 6)::double as entity_overlap_score, (doc_id % 9)::double as name_ambiguity, len(string_split(kb_name, ' '))::double as link_name_length from h""")
def link_features(spark, sf_dir):
    """All fourteen features of a query and its candidate."""
    w = F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", w.alias("w"))
    d = d.withColumn("entity", F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.concat_ws(" ", "lang", "source")))
    kb_name = F.when(F.col("doc_id") % 5 == 0, F.col("source")).when(F.col("doc_id") % 5 == 1, F.col("entity")).otherwise(F.coalesce(F.get("w", F.lit(1)), F.lit("None")))
    m = d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("name"), "entity", F.concat(F.when(F.col("doc_id") % 3 == 0, "eng-").otherwise("x-"), "doc_id").alias("doc_id"),
        F.array(F.lit("one two three"), F.lit("four five")).alias("contexts"), F.array_distinct(F.slice("w", 1, 6)).alias("source_entities"), ((F.col("doc_id") % 10) / 10.0).alias("candidate_score"),
        ((F.col("doc_id") % 7) / 7.0).alias("docsim"), (F.col("doc_id") % 50).alias("inlinks"), kb_name.alias("kb_name"), F.array_distinct(F.slice("w", 5, 5)).alias("kb_entities"), (F.col("doc_id") % 9).alias("n_titles"),
    )
    out = m.select("id", *[c.alias(k) for k, c in candidates.link_features().items()]).withColumnRenamed("id", "doc_id")
    return rounded(out, "log_inlinks", "entity_overlap_score")
