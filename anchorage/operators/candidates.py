"""Candidate entities of surface strings, and their scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import word_count
from ..sources import store


def anchor_priors(anchors: DataFrame) -> DataFrame:
    """anchors(surface, kb_name, n) -> (surface, kb_name, candidate_score): the share of a surface's links that go to the entity."""
    counts = anchors.groupBy("surface", "kb_name").agg(F.sum("n").alias("n"))
    total = counts.groupBy("surface").agg(F.sum("n").alias("all"))
    return counts.join(total, "surface").select("surface", "kb_name", (F.col("n") / F.col("all")).alias("candidate_score"))


def ranked(candidates: DataFrame, by: list[str], score: str, tie: str = "kb_name") -> DataFrame:
    """Adds rank, 1 for the best of each group."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def best(candidates: DataFrame, by: list[str], score: str, tie: str = "kb_name") -> DataFrame:
    return ranked(candidates, by, score, tie).where("rank = 1").drop("rank")


def exact_title(names: DataFrame, name: str, kb: DataFrame) -> DataFrame:
    """Adds kb_id of the entity whose title is the name, by case; of several the last loaded wins (kb(kb_id, title, line_no))."""
    by_title = kb.groupBy(F.col("title").alias("__title")).agg(F.max_by("kb_id", "line_no").alias("kb_id"))
    return names.join(by_title, F.col(name) == F.col("__title"), "left").drop("__title")


def titles_holding(names: DataFrame, titles: DataFrame) -> DataFrame:
    """names(name, low), titles(title, low), each row once -> (name, title): the titles whose `low` holds the name's.

    Both meet on the name's first three letters, which every title that holds it has somewhere, so no pair is formed that
    shares none. The titles' letters are many rows for each title, which Spark's estimate does not know of: that side is never broadcast.
    """
    n = names.where(F.length("low") > 0).select("name", F.col("low").alias("__n"), F.left("low", F.lit(3)).alias("__g"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.substring("low", i, k)))))
    t = titles.where(F.length("low") > 0).select("title", F.col("low").alias("__t"), F.explode(grams).alias("__g"))
    return n.join(t.hint("shuffle_merge"), "__g").where(F.contains("__t", F.col("__n"))).select("name", "title")


def ambiguity(names: DataFrame, name: str, kb: DataFrame, ignore_case: bool = True) -> DataFrame:
    """(name, n_titles): titles that hold the name, by titles_holding(). Entries with the same titles are counted first and met as one."""
    low = F.lower if ignore_case else (lambda c: c)
    root = store.folder(names.sparkSession)
    n = store.written(names.select(F.col(name).alias("name")).where(F.length(name) > 0).distinct(), root, "names")
    own = kb.where(F.length("title") > 0).groupBy("kb_id").agg(F.sort_array(F.collect_set(low(F.col("title")))).alias("own"))
    own = store.written(own.where("kb_id is not null").groupBy("own").agg(F.count("*").alias("n")), root, "titles")
    titles = own.select(F.explode("own").alias("title")).distinct().select("title", F.col("title").alias("low"))
    met = titles_holding(n.select("name", low(F.col("name")).alias("low")), titles)
    met = met.join(own.select("own", "n", F.explode("own").alias("title")), "title").groupBy("name", "own").agg(F.first("n").alias("n"))
    counts = met.groupBy("name").agg(F.sum("n").alias("n_titles"))
    return n.join(counts, "name", "left").fillna(0, ["n_titles"])


#: Features of a query and its candidate; the classifier takes the first two.
LINK_FEATURES = (
    "candidate_score", "docsim", "log_inlinks", "original_name_match", "full_name_match", "full_name_found", "is_web_document", "coref_context_length",
    "full_name_length", "original_name_length", "entity_overlap", "entity_overlap_score", "name_ambiguity", "link_name_length",
)
ACTIVE_LINK_FEATURES = LINK_FEATURES[:2]


def link_features() -> dict[str, Column]:
    """Columns over (name, entity, doc_id, contexts, source_entities, candidate_score, docsim, inlinks, kb_name, kb_entities, n_titles)."""
    c, flag = F.col, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    other = F.filter("source_entities", lambda s: ~F.contains(s, c("kb_name")))
    shared = F.size(F.array_intersect(other, c("kb_entities")))
    f = {
        "candidate_score": c("candidate_score"), "docsim": c("docsim"), "log_inlinks": F.when(c("inlinks") > 0, F.ln("inlinks")).otherwise(0.0),
        "original_name_match": flag(c("name") == c("kb_name")), "full_name_match": flag(c("entity") == c("kb_name")), "full_name_found": flag(c("entity") != c("name")),
        "is_web_document": flag(c("doc_id").rlike("^(eng-|bolt-)")), "coref_context_length": F.aggregate("contexts", F.lit(0.0), lambda a, x: a + word_count(x)),
        "full_name_length": word_count("entity").cast("double"), "original_name_length": word_count("name").cast("double"),
        "entity_overlap": flag(F.arrays_overlap(other, c("kb_entities"))), "entity_overlap_score": F.coalesce(F.try_divide(shared.cast("double"), F.size(other)), F.lit(0.0)),
        "name_ambiguity": c("n_titles").cast("double"), "link_name_length": word_count("kb_name").cast("double"),
    }
    return {k: f[k] for k in LINK_FEATURES}


def logistic(weights: Mapping[str, float], features: Mapping[str, Column], intercept: float = 0.0) -> Column:
    """Logistic score of a linear model; features without a weight count nothing."""
    z = F.lit(float(intercept))
    for k in sorted(weights):
        z = z + features[k] * F.lit(float(weights[k]))
    return 1 / (1 + F.exp(-z))
