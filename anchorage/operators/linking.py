"""The decision cascade that turns scored candidates into links, as columns of one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import backoff_strings, confidence, without_parentheses, word_count
from ..sources import store
from . import nil

THRESHOLD = 0.93
#: Words of a type by which a place or a team is known.
PLACE_TYPES, TEAM_TYPES = "settlement|city|place|province|country|county", "team|club"


def is_location(wiki_type: Column, structured_type: Column) -> Column:
    return F.coalesce(F.lower(wiki_type).rlike(PLACE_TYPES), F.lit(False)) | F.coalesce(structured_type == "GPE", F.lit(False))


def is_team(wiki_type: Column) -> Column:
    return F.coalesce(F.lower(wiki_type).rlike(TEAM_TYPES), F.lit(False))


def backoff_eligible() -> Column:
    return (word_count("entity") > word_count("name") + 1) & ~F.contains("entity", F.lit(",")) & ~F.contains("entity", F.lit("."))


def backoff_best(mentions: DataFrame, scored: DataFrame) -> DataFrame:
    """(query_id, b_surface, b_link, b_score): the best positive score over the back-off strings of eligible mentions, the first generated on ties."""
    tries = mentions.where(backoff_eligible()).select("query_id", F.posexplode(backoff_strings("name", "entity")).alias("ord", "surface"))
    met = tries.join(scored.where("rank = 1"), ["query_id", "surface"]).where("score > 0")
    top = met.groupBy("query_id").agg(F.min_by(F.struct("surface", "kb_name", "score"), F.struct((-F.col("score")).alias("s"), "ord")).alias("b"))
    return top.select("query_id", F.col("b.surface").alias("b_surface"), F.col("b.kb_name").alias("b_link"), F.col("b.score").alias("b_score"))


def titles_of(kb: DataFrame) -> DataFrame:
    """(title, k struct<kb_id, wiki_type, structured_type>): of several entries with a title the last."""
    return kb.groupBy("title").agg(F.max_by(F.struct("kb_id", "wiki_type", "structured_type"), "line_no").alias("k"))


def link(mentions: DataFrame, scored: DataFrame, kb: DataFrame, threshold: float = THRESHOLD, nil_parity: bool = False) -> DataFrame:
    """mentions(pos, query_id, name, entity, sports, error_reason), scored(query_id, surface, kb_name, score, rank), kb(kb_id, title,
    wiki_type, structured_type, line_no) -> (pos, query_id, name, entity, kb_link, confidence, score, path).

    In order: a candidate over the threshold; the exact title; the back-off strings; none. A team takes the place of a
    location where the mention has the sports sense. Mentions with an error_reason link to nothing at 0.1. nil_parity: a
    linked entity that the knowledge base lacks burns an identifier, which leaves gaps in their numbers.

    Titles, which are met four times, and decisions, which are numbered in two passes, are written once each.
    """
    root = store.folder(mentions.sparkSession)
    titles = store.written(titles_of(kb), root, "titles")
    decided = store.written(decisions(mentions, scored, titles, threshold, nil_parity), root, "decided")
    out = nil.allocate(decided)
    return out.select("pos", "query_id", "name", "entity", F.coalesce("kb_id", "nil_id").alias("kb_link"), F.col("conf").alias("confidence"), "score", "path")


def decisions(mentions: DataFrame, scored: DataFrame, titles: DataFrame, threshold: float = THRESHOLD, nil_parity: bool = False) -> DataFrame:
    """link() before the mentions that link to nothing get their numbers: (pos, query_id, name, entity, kb_id, conf, score, path, consumed)."""
    top = scored.where("rank = 1").select(F.col("query_id").alias("__q"), F.col("surface").alias("__s"), F.col("kb_name").alias("top"), F.col("score").alias("top_score"))
    m = mentions.join(top, (F.col("query_id") == F.col("__q")) & (F.col("entity") == F.col("__s")), "left").drop("__q", "__s")
    m = m.join(backoff_best(mentions, scored), "query_id", "left")
    for key, name in (("top", "t"), ("entity", "x"), ("b_link", "bk")):
        m = m.join(titles.select(F.col("title").alias(f"__{name}"), F.col("k").alias(name)), F.col(key) == F.col(f"__{name}"), "left").drop(f"__{name}")
    error = F.col("error_reason").isNotNull()
    high = F.coalesce(F.col("top_score") > threshold, F.lit(False))
    exact = (F.col("entity") != F.col("name")) & F.col("x").isNotNull()
    back = F.col("b_link").isNotNull() & ((F.col("b_score") > threshold) | (F.col("b_surface") == F.col("b_link")))
    path = F.when(error, "error").when(high, "candidate").when(exact, "title").when(back, "backoff").otherwise("none")
    m = m.withColumn("path", path)
    pick = lambda t, x, b: F.when(F.col("path") == "candidate", t).when(F.col("path") == "title", x).when(F.col("path") == "backoff", b)
    m = m.withColumns({
        "kb": pick(F.col("t"), F.col("x"), F.col("bk")),
        "conf": F.when(F.col("path") == "error", 0.1).when(F.col("path") == "none", 0.55).otherwise(pick(confidence("top_score", threshold), F.lit(0.8), confidence("b_score", threshold))),
        "score": F.when(F.col("path") == "backoff", F.col("b_score")).otherwise(F.coalesce("top_score", F.lit(0.0))),
        "entity": F.when((F.col("path") == "candidate") & F.col("t").isNull(), without_parentheses("top")).when((F.col("path") != "candidate") & ~exact & F.col("b_link").isNotNull() & ~error, F.col("b_surface")).otherwise(F.col("entity")),
    })
    team = scored.where(F.col("score") > threshold).join(titles.select(F.col("title").alias("__title"), "k"), F.col("kb_name") == F.col("__title"))
    team = team.where(is_team(F.col("k.wiki_type"))).groupBy(F.col("query_id").alias("__q"), F.col("surface").alias("__s")).agg(F.min_by("k.kb_id", "rank").alias("team"))
    m = m.join(team, (F.col("query_id") == F.col("__q")) & (F.col("entity") == F.col("__s")), "left")
    moved = F.coalesce(F.col("sports"), F.lit(False)) & F.col("kb").isNotNull() & is_location(F.col("kb.wiki_type"), F.col("kb.structured_type"))
    kb_id = F.when(moved, F.col("team")).otherwise(F.col("kb.kb_id"))
    burnt = F.lit(2) if nil_parity else F.lit(1)
    used = F.when(F.col("kb_id").isNotNull(), 0).when((F.col("path") == "candidate") & F.col("kb").isNull(), burnt).otherwise(1)
    m = m.withColumns({"kb_id": kb_id, "conf": F.when(moved & F.col("team").isNotNull(), 0.7).when(moved, 0.5).otherwise(F.col("conf"))}).withColumn("consumed", used)
    return m.select("pos", "query_id", "name", "entity", "kb_id", "conf", "score", "path", "consumed")


def passage_links(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold the whole text of an item, each once; empty and null items are in none.

    Both sides meet on the item's second to fourth word, which a document that holds it has in a row: an equi-join in place
    of a test of all pairs. Only ids and keys are shuffled, and the pairs that met are sent to their texts, unless they are many.
    """
    w = lambda c: F.regexp_extract_all(c, F.lit(r"[A-Za-z]+"), F.lit(0))
    items = items.where("text <> ''").select("item_id", F.col("text").alias("passage"))
    keyed = items.select("item_id", w(F.col("passage")).alias("own")).select("item_id", F.size("own").alias("n_own"), F.array_join(F.slice("own", 2, 3), " ").alias("key"))
    # The words are a column of their own: within a lambda an expression is worked out for each element anew.
    worded = docs.select("doc_id", w(F.col("text")).alias("words"))
    n = F.greatest(F.size("words") - 2, F.lit(0))
    grams = F.transform(F.arrays_zip(F.slice("words", 1, n), F.slice("words", 2, n), F.slice("words", 3, n)), lambda x: F.concat_ws(" ", x["0"], x["1"], x["2"]))
    pairs = worded.select("doc_id", F.explode(F.array_distinct(grams)).alias("key")).join(keyed.where("n_own >= 5"), "key").select("doc_id", "item_id").distinct()
    pairs = store.written(pairs, store.folder(docs.sparkSession), "pairs")
    out = docs.select("doc_id", "text").join(F.broadcast(pairs) if store.small(pairs) else pairs, "doc_id").join(items, "item_id").where(F.contains("text", F.col("passage"))).select("doc_id", "item_id")
    # An item of under five words may begin or end within the words of its key.
    loose = keyed.where("n_own < 5").join(items, "item_id").select("item_id", "passage")
    if not loose.isEmpty():
        out = out.union(docs.select("doc_id", "text").join(loose, F.contains("text", F.col("passage"))).select("doc_id", "item_id"))
    return out.distinct()
