"""Training data and evaluation of the three classifiers: links, pairs of mentions, the sports sense."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ACTIVE_PAIR_FEATURES, pair_features
from ..functions.stems import context_terms
from ..operators import bayes
from ..operators.candidates import ACTIVE_LINK_FEATURES, logistic, titles_holding
from ..operators.pairs import sample_pairs
from ..sources import store
from . import models

#: Deals of a search that are worked on at a time.
DEALS = 10
#: Rows of features in a partition at least, so that the many short jobs over few numbers are not made of empty tasks.
ROWS = 100_000
YEARS = ("2010", "2011", "2012", "2013")
#: The years whose answers train the model for a year.
TRAINED_ON = {"2011": ("2012",), "2012": ("2011",), "2013": ("2011", "2012")}


def checked_year(year: str) -> str:
    """The year, if there are queries of it; only those that other years can train a model for can be linked (see training_years())."""
    if str(year) not in YEARS:
        raise ValueError(f"year {year}: one of {', '.join(YEARS)} is needed")
    return str(year)


def training_years(year: str) -> tuple[str, ...]:
    if checked_year(year) not in TRAINED_ON:
        raise ValueError(f"no training years for {year}")
    return TRAINED_ON[str(year)]


def labelled_candidates(training: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """training(label, query_id, used, expected), queries(query_id, ...), candidates(surface, kb_name, ...) -> a row for each training line whose query is known and whose string has the expected candidate, with label and the columns of both; others are left out."""
    t = training.select("label", "query_id", F.col("used").alias("entity"), F.col("expected").alias("kb_name"))
    q = queries.drop(*[c for c in ("entity",) if c in queries.columns])
    return t.join(q, "query_id").join(candidates.withColumnRenamed("surface", "entity"), ["entity", "kb_name"])


def train_links(rows: DataFrame, features: Sequence[str] = ACTIVE_LINK_FEATURES) -> tuple[dict[str, float], float]:
    """(weights, intercept) of the link classifier over labelled candidates."""
    return models.train_logistic(rows, features, "label")


def scored_by(rows: DataFrame, weights: Mapping[str, float], intercept: float, score: str = "score") -> DataFrame:
    return rows.withColumn(score, logistic(weights, {k: F.col(k) for k in weights}, intercept))


def _features(rows: DataFrame, key: str, features: Sequence[str], *more: str) -> DataFrame:
    """What training and measuring read of the rows, many times over: worked out and written once."""
    out = store.written(rows.select(key, "label", *more, *features), store.folder(rows.sparkSession), "features")
    return out.coalesce(out.count() // ROWS + 1)


def threshold_search(rows: DataFrame, key: str, features: Sequence[str] = ACTIVE_LINK_FEATURES, splits: int = 10, share: int = 10, seed: int = 0) -> DataFrame:
    """(split, threshold, f1): the threshold of best F1 on a random tenth by a model of the rest, for each of `splits` seeded deals. Their mean is the threshold of the linker."""
    rows, spark = _features(rows, key, features), rows.sparkSession

    def deal(i: int) -> tuple[int, float | None, float | None]:
        test = F.pmod(F.xxhash64(F.col(key), F.lit(seed + i)), F.lit(share)) == 0
        w, b = models.train_logistic(rows.where(~test), features, "label")
        best = models.best_threshold(scored_by(rows.where(test), w, b).withColumn("__y", F.col("label").cast("int")), "__y", "score", key)
        return i, *best.select("threshold", "f1").first()

    # Each deal is a chain of many short jobs; those of the others run meanwhile. Only one row of each comes back.
    with ThreadPool(max(1, min(splits, DEALS))) as pool:
        found = pool.map(inheritable_thread_target(spark)(deal), range(splits))
    return spark.createDataFrame(found, "split int, threshold double, f1 double")


def precision_lines(rows: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """(rank, line): interpolated precision, rank as a share of all, and score of each row, from the highest score down."""
    at = models.interpolated_precision(rows.withColumn("__y", F.col(label).cast("int")), "__y", score, key)
    at = at.join(rows.select(F.col(key).alias("tie"), F.col(score).alias("score")), "tie")
    return at.select("rank", F.concat_ws("\t", F.format_string("%.2f", "interpolated"), F.format_string("%.2f", "rank_fraction"), F.col("score").cast("string")).alias("line"))


def cross_year(rows: DataFrame, train_on: str, test_on: str, key: str, features: Sequence[str] = ACTIVE_LINK_FEATURES) -> DataFrame:
    """precision_lines() of one year's labelled candidates by a model of another's; rows(year, label, ...)."""
    rows = _features(rows, key, features, "year")
    w, b = models.train_logistic(rows.where(F.col("year") == train_on), features, "label")
    return precision_lines(scored_by(rows.where(F.col("year") == test_on), w, b), "label", "score", key)


def answered(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """queries with the kb_link of their answer; a query without one is left out."""
    return queries.join(answers.select("query_id", "kb_link"), "query_id")


#: Tiles on a side of all pairs of a block, which are dealt over their square.
TILES = 16


def labelled_pairs(mentions: DataFrame, block: str | None = None) -> DataFrame:
    """mentions(query_id, kb_link, ...) -> (a, b, label), a before b: whether both have the same link. Where all pairs are asked for, there
    are as many as there are; with a block column, pairs of one block only. Rows go to tiles of a square, not all to one
    key. A training sample is drawn without them: operators.pairs.sample_pairs()."""
    own = F.pmod(F.xxhash64("query_id"), F.lit(TILES)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(TILES - 1)))
    by = F.col(block) if block else F.lit(1)
    left = mentions.select(F.struct(*mentions.columns).alias("a"), by.alias("__b"), own.alias("__i"), every.alias("__j"))
    right = mentions.select(F.struct(*mentions.columns).alias("b"), by.alias("__b"), every.alias("__i"), own.alias("__j"))
    return left.join(right, ["__b", "__i", "__j"]).where("a.query_id < b.query_id").select("a", "b", (F.col("a.kb_link") == F.col("b.kb_link")).alias("label"))


def speaks_of(vocabulary: Column, *names: Column) -> Column:
    """Whether a word of the vocabulary holds one of the names."""
    low = F.array(*[F.lower(n) for n in names])
    return F.coalesce(F.exists(vocabulary, lambda w: F.exists(low, lambda n: F.contains(w, n))), F.lit(False))


def plausible_pair() -> Column:
    """Over pairs(a, b of name, entity, vocabulary): whether the context of either speaks of the other."""
    return speaks_of(F.col("a.vocabulary"), F.col("b.name"), F.col("b.entity")) | speaks_of(F.col("b.vocabulary"), F.col("a.name"), F.col("a.entity"))


def train_pairs(mentions: DataFrame, drawn: DataFrame | None = None, surnames: Sequence[str] = (), features: Sequence[str] = ACTIVE_PAIR_FEATURES, seed: int = 0) -> tuple[dict[str, float], float]:
    """(weights, intercept) of the pair classifier. mentions(query_id, kb_link, name, entity, and the term maps context, wide, coref, links,
    args); drawn(a, b, label): the sample to train on, drawn from the mentions if it is not given."""
    root = store.folder(mentions.sparkSession)
    drawn = store.written(sample_pairs(mentions, seed) if drawn is None else drawn, root, "drawn")
    ids = drawn.select(F.col("a").alias("query_id")).union(drawn.select("b")).distinct()
    own = store.written(mentions.withColumn("query_id", F.col("query_id").cast("string")).join(F.broadcast(ids), "query_id"), root, "mentions")
    side = lambda c: own.select(F.col("query_id").alias(f"__{c}"), F.struct(*own.columns).alias(f"m{c}"))
    both = drawn.join(side("a"), F.col("a") == F.col("__a")).join(side("b"), F.col("b") == F.col("__b")).select(F.col("ma").alias("a"), F.col("mb").alias("b"), "label")
    return models.train_logistic(store.written(pair_features(both, surnames).select(*features, "label"), root, "features"), features, "label")


def entry_is_team(wiki_type: Column) -> Column:
    """Whether the type of an entry names a team or club, by case; null where there is no entry."""
    return F.contains(wiki_type, F.lit("team")) | F.contains(wiki_type, F.lit("club"))


def sports_candidate(is_place: Column, ner_type: Column) -> Column:
    """Whether a mention can have the sports sense: it has the name of a place and is no person."""
    return is_place & F.coalesce(ner_type != "PERSON", F.lit(True))


def sports_rows(mentions: DataFrame, kb: DataFrame) -> DataFrame:
    """mentions(query_id, kb_link, is_place, ner_type, ...), kb(kb_id, wiki_type) -> the candidates that link to an entry of known type, with label."""
    m = mentions.where(sports_candidate(F.col("is_place"), F.col("ner_type")) & ~F.startswith("kb_link", F.lit("NIL")))
    return m.join(kb.select(F.col("kb_id").alias("kb_link"), "wiki_type"), "kb_link").withColumn("label", entry_is_team(F.col("wiki_type")))


def sports_evaluation(rows: DataFrame, key: str, features: Sequence[str], seed: int = 0, ascending: bool = False) -> DataFrame:
    """rows(label, text, features without text_score) -> (rank, line): a fifth of the rows, dealt by a seeded hash, by a model of the rest whose text score, the log of a team's sense and the text, comes from naive Bayes on half of all rows.

    Lines go from the highest score down, as precision is read; ascending: from the lowest up.
    """
    turn = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    root = store.folder(rows.sparkSession)
    at = store.written(rows.withColumns({"__turn": turn, "terms": context_terms(F.col("text")), "y": F.col("label").cast("int")}).drop("text"), root, "terms")
    bayes.save(bayes.train(at.where("__turn >= 50"), key, "terms", "y"), f"{root}/text_model")
    at = bayes.scored(at, key, "terms", bayes.load(rows.sparkSession, f"{root}/text_model")).withColumn("text_score", F.col("text_log"))
    at = store.written(at.drop("terms"), root, "scored")
    names = [*features, "text_score"]
    w, b = models.train_logistic(at.where("__turn >= 20"), names, "y")
    test = scored_by(at.where("__turn < 20"), w, b)
    if ascending:
        test = test.withColumns({"own": F.col("score"), "score": -F.col("score")})
        return precision_lines(test, "y", "score", key)
    return precision_lines(test, "y", "score", key)


def teams_named(names: DataFrame, name: str, kb: DataFrame) -> DataFrame:
    """names(name) -> (name, kb_id): the first entry, by title, whose title holds the name and whose type names a team. Of entries with one title only the first is met."""
    root = store.folder(names.sparkSession)
    n = store.written(names.select(F.col(name).alias("name")).where(F.length(name) > 0).distinct(), root, "names")
    t = kb.where(entry_is_team(F.col("wiki_type")) & (F.length("title") > 0)).groupBy("title").agg(F.min("kb_id").alias("kb_id"))
    t = store.written(t, root, "titles")
    # By lower case they meet, by case they are compared.
    met = titles_holding(n.withColumn("low", F.lower("name")), t.select("title", F.lower("title").alias("low"))).where(F.contains("title", F.col("name")))
    return met.join(t, "title").groupBy("name").agg(F.min(F.struct("title", "kb_id")).alias("k")).select("name", F.col("k.kb_id").alias("kb_id"))


def augmented_lines(training: DataFrame, ambiguity: DataFrame) -> DataFrame:
    """(value): each training line with the number of titles that hold its string; ambiguity(name, n_titles)."""
    t = training.join(ambiguity.withColumnRenamed("name", "used"), "used", "left")
    return t.select(F.concat_ws("\t", F.when(F.col("label"), "CORRECT").otherwise("WRONG"), "query_id", "used", "expected", F.coalesce("n_titles", F.lit(0)).cast("string")).alias("value"))


def entry_entity_lines(entries: DataFrame, entities: DataFrame) -> DataFrame:
    """entries(kb_id, doc_id), entities: entities_by_type() -> (value): each entry once, with people, organizations and locations of its text."""
    one = entries.dropDuplicates(["kb_id"]).join(entities, "doc_id", "left")
    return one.select(F.concat_ws("\t", "kb_id", "people", "orgs", "locs").alias("value"))
