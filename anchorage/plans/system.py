"""The linker and its evaluation from files, and the other tools that work on the files of a base folder.

A base folder holds, for a year Y: queries_Y.xml, answers_Y.tab, documents_Y (Parquet: doc_id, text), entities_Y (records of
four lines), spans_Y (coreference spans), tokens_Y (Parquet: doc_id, sent, idx, token, type, begin, end, and chain, else chains are made of the entities' names), training_Y.csv;
and for all years kb/title, kb/intro, kb/wiki_type, kb/structured_type, anchors (Parquet: surface, kb_name, n),
gazetteer.txt and sports.model. What only some tools need may be missing for the others.

Models that are trained and kept here: link_Y.model (weights of the link classifier) and sports_text (Parquet: counts of the
text model). The linker takes them where they are: without the first it links by the share of anchors, without the second
texts say nothing of the sports sense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stems import context_terms
from ..operators import aliases, annotations, bayes, candidates, coref, evaluate, linking, nil, surface
from ..sources import readers, store, writers
from . import learning, models


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def knowledge_base(spark: SparkSession, base: str) -> DataFrame:
    read = lambda name, columns: readers.kb_map(spark, f"{base}/kb/{name}", columns, "kb_id")
    return readers.knowledge_base(read("title", ("kb_id", "title")), read("intro", ("kb_id", "intro")), read("wiki_type", ("kb_id", "wiki_type")), read("structured_type", ("structured_type", "kb_id")))


def queries(spark: SparkSession, base: str, year: str) -> DataFrame:
    """The year's queries with the text of their documents and the context of the mention; the offset is the name's first place where it is not given."""
    q = readers.queries_xml(spark, f"{base}/queries_{learning.checked_year(year)}.xml", year)
    q = readers.with_documents(q, spark.read.parquet(f"{base}/documents_{year}"))
    q = q.withColumn("context", tx.context("text", "name", "beg"))
    return q.withColumn("beg", tx.resolved_offset("text", "name", "beg"))


def annotated_files(spark: SparkSession, base: str, year: str) -> None:
    """Makes entities_Y and spans_Y from tokens_Y, each if it is missing."""
    q = queries(spark, base, year)
    if not exists(spark, f"{base}/entities_{year}"):
        t = spark.read.parquet(f"{base}/tokens_{year}")
        lists = annotations.entities_by_type(annotations.merged_entities(t))
        inside = q.select("query_id", "doc_id", "beg", F.col("end").alias("stop")).join(t.select("doc_id", "begin", "type"), "doc_id").where((F.col("begin") >= F.col("beg")) & (F.col("begin") <= F.col("stop")) & F.col("type").isin(*annotations.TYPES))
        kind = inside.groupBy("query_id").agg(F.min_by("type", "begin").alias("ner_type"))
        e = q.select("query_id", "doc_id").join(lists, "doc_id", "left").join(kind, "query_id", "left")
        of = {"ORGANIZATION": "orgs", "LOCATION": "locs", "PERSON": "people"}
        matching = F.coalesce(*[F.when(F.col("ner_type") == k, F.col(c)) for k, c in of.items()], F.array().cast("array<string>"))
        none = F.array().cast("array<string>")
        e = e.select("query_id", F.coalesce("ner_type", F.lit("")).alias("ner_type"), matching.alias("matching"), *[F.coalesce(c, none).alias(c) for c in of.values()])
        writers.write_lines(writers.entity_lines(e), f"{base}/entities_{year}")
    if not exists(spark, f"{base}/spans_{year}"):
        t = spark.read.parquet(f"{base}/tokens_{year}")
        if "chain" in t.columns:
            m = t.where("chain is not null").groupBy("doc_id", "chain", "sent").agg(F.min("idx").alias("from_idx"), (F.max("idx") + 1).alias("to_idx"))
        else:
            m = coref.chains(annotations.merged_entities(t)).select("doc_id", F.concat_ws("|", "type", "chain").alias("chain"), "sent", F.col("first").alias("from_idx"), (F.col("last") + 1).alias("to_idx"))
        writers.write_lines(writers.span_lines(annotations.chain_of(q.select("query_id", "doc_id", "beg", "end"), annotations.mention_spans(m, t))), f"{base}/spans_{year}")


def gazetteer_of(spark: SparkSession, base: str) -> tuple[surface.Gazetteer, DataFrame | None]:
    """The gazetteer as one object, a row for each named place of the world at most, and its places as a table."""
    if not exists(spark, f"{base}/gazetteer.txt"):
        return surface.Gazetteer(), None
    places, within = readers.gazetteer(spark, f"{base}/gazetteer.txt")
    kinds: dict[str, set] = {}
    for r in places.toLocalIterator():
        kinds.setdefault(r["kind"], set()).add(r["name_lc"])
    held = {r["container"]: frozenset(r["cities"]) for r in within.groupBy("container").agg(F.collect_set("city").alias("cities")).toLocalIterator()}
    return surface.Gazetteer(frozenset(kinds.get("city", ())), frozenset(kinds.get("state", ())), frozenset(kinds.get("country", ())), held), places


def with_text_log(spark: SparkSession, mentions: DataFrame, base: str) -> DataFrame:
    """mentions with text_log of the text model in the base folder; 0 where there is none."""
    if not exists(spark, f"{base}/sports_text"):
        return mentions.withColumn("text_log", F.lit(0.0))
    own = store.written(mentions.select("query_id", context_terms(F.col("text")).alias("terms")), store.folder(spark), "terms")
    scored = bayes.scored(own, "query_id", "terms", bayes.load(spark, f"{base}/sports_text")).select("query_id", "text_log")
    return mentions.join(scored, "query_id", "left").withColumn("text_log", F.coalesce("text_log", F.lit(0.0)))


def train_sports_text(spark: SparkSession, base: str, year: str) -> DataFrame:
    """The text model for a year, of the answered mentions of the years that may train it that have the name of a place: whether the entry is a team, by the stems of the whole document. Kept in the base folder and read again."""
    places = gazetteer_of(spark, base)[1]
    names = (places if places is not None else spark.createDataFrame([], "name_lc string, kind string")).select("name_lc").distinct()
    rows = None
    for y in learning.training_years(year):
        q = queries(spark, base, y).join(readers.answers_tsv(spark, f"{base}/answers_{y}.tab").select("query_id", "kb_link"), "query_id")
        q = annotations.with_entities(q, readers.named_entities(spark, f"{base}/entities_{y}"))
        q = q.join(names.withColumn("is_place", F.lit(True)), F.lower("name") == F.col("name_lc")).drop("name_lc")
        one = learning.sports_rows(q, knowledge_base(spark, base)).select("query_id", "label", context_terms(F.col("text")).alias("terms"))
        rows = one if rows is None else rows.union(one)
    bayes.save(bayes.train(store.written(rows, store.folder(spark), "rows"), "query_id", "terms", "label"), f"{base}/sports_text")
    return bayes.load(spark, f"{base}/sports_text")


def with_sports_sense(spark: SparkSession, mentions: DataFrame, base: str, places: DataFrame | None, entities: DataFrame) -> DataFrame:
    """mentions with `sports`, by the model file of the base folder: null for what has no place's name or is a person. entities(query_id, orgs): what the mentions have their organizations from."""
    weights, intercept = readers.linear_model(spark, f"{base}/sports.model")
    names = (places if places is not None else spark.createDataFrame([], "name_lc string, kind string")).select("name_lc").distinct().withColumn("__place", F.lit(True))
    m = mentions.join(names, F.lower("name") == F.col("name_lc"), "left").withColumn("is_place", F.coalesce("__place", F.lit(False))).drop("name_lc", "__place")
    ratio = annotations.organizations_with_locations(entities.select("query_id", "orgs"), "query_id", "orgs", names.select("name_lc"))
    m = m.join(ratio, "query_id", "left").withColumn("ratio", F.coalesce("ratio", F.lit(10.0)))
    full = annotations.fully_specified_location(F.col("context"), F.col("name"), F.col("locs")).cast("double")
    m = with_text_log(spark, m, base)
    f = models.sports_features(F.col("context"), F.col("name"), F.col("ner_type"), F.col("text_log"), F.col("ratio"), full)
    p = candidates.logistic(models.by_column(weights), f, intercept)
    return m.withColumn("sports", models.sports_sense(learning.sports_candidate(F.col("is_place"), F.col("ner_type")), p)).drop("ratio", "is_place", "text_log")


def expanded_mentions(spark: SparkSession, base: str, year: str, sports: bool = False) -> DataFrame:
    """(pos, query_id, name, entity, context, sports, error_reason): the year's queries under the names that their documents give them. The only stage of the linker that reads texts."""
    entities = readers.named_entities(spark, f"{base}/entities_{year}")
    m = annotations.with_entities(queries(spark, base, year), entities).withColumnRenamed("error_reason", "missing")
    m = annotations.with_spans(m, readers.coref_spans(spark, f"{base}/spans_{year}")) if exists(spark, f"{base}/spans_{year}") else m.withColumn("spans", F.array().cast("array<struct<start:int,end:int>>"))
    gaz, places = gazetteer_of(spark, base)
    m = with_sports_sense(spark, m, base, places, entities) if sports else m.withColumn("sports", F.lit(None).cast("boolean"))
    return surface.entity_strings(m, gaz).select("pos", "query_id", "name", "entity", "context", "sports", F.coalesce("missing", "error_reason").alias("error_reason"))


def candidate_strings(mentions: DataFrame) -> DataFrame:
    """(query_id, entity): the names of mentions and their back-off strings."""
    tries = mentions.where(linking.backoff_eligible()).select("query_id", F.explode(tx.backoff_strings("name", "entity")).alias("entity"))
    return mentions.select("query_id", "entity").union(tries).distinct()


def with_docsim(rows: DataFrame) -> DataFrame:
    """rows(own, theirs: term lists of a mention and of an entry) with docsim in their place: the share of all terms that both have."""
    sim = F.try_divide(F.size(F.array_intersect("own", "theirs")), F.size(F.array_union("own", "theirs")))
    return rows.withColumn("docsim", F.coalesce(sim, F.lit(0.0)).cast("double")).drop("own", "theirs")


def model_candidates(mentions: DataFrame, priors: DataFrame, kb: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """scored_candidates() by a trained link classifier: candidates come from the aliases near a string, so a misspelt name has
    some too, and their score is the probability that the link is right. mentions also have their context, kb its intro.

    Each distinct string is looked up once; terms are made once for each mention and each entry that is a candidate.
    """
    spark = mentions.sparkSession
    root = store.folder(spark)
    strings = store.written(candidate_strings(mentions), root, "strings")
    found = store.written(aliases.top_candidates(strings, "entity", priors), root, "found")
    rows = strings.join(found, F.col("entity") == F.col("string")).select("query_id", F.col("string").alias("surface"), "kb_name", "candidate_score")
    own = mentions.select("query_id", context_terms(F.coalesce("context", F.lit(""))).alias("own"))
    entries = kb.select(F.col("title").alias("kb_name"), "intro", "line_no").join(found.select("kb_name").distinct(), "kb_name", "left_semi")
    entries = entries.groupBy("kb_name").agg(F.max_by("intro", "line_no").alias("intro"))
    theirs = store.written(entries.select("kb_name", context_terms(F.coalesce("intro", F.lit(""))).alias("theirs")), root, "theirs")
    rows = with_docsim(rows.join(store.written(own, root, "own"), "query_id").join(theirs, "kb_name", "left"))
    rows = learning.scored_by(rows, weights, intercept)
    return candidates.ranked(rows.select("query_id", "surface", "kb_name", "score"), ["query_id", "surface"], "score")


def scored_candidates(mentions: DataFrame, priors: DataFrame) -> DataFrame:
    """(query_id, surface, kb_name, score, rank) of the strings of mentions; priors(surface, kb_name, candidate_score)."""
    strings = candidate_strings(mentions)
    scored = strings.join(priors, F.col("entity") == F.col("surface")).select("query_id", "surface", "kb_name", F.col("candidate_score").alias("score"))
    return candidates.ranked(scored, ["query_id", "surface"], "score")


def link(spark: SparkSession, base: str, year: str, sports: bool = False, from_scratch: bool = False) -> DataFrame:
    """(pos, query_id, name, entity, kb_link, confidence): the year's queries linked and their NILs clustered by string.

    A candidate's score is the link classifier's where the base folder has link_Y.model, and candidates are then looked up
    with edits; else it is its share of the anchors of the string. Queries without annotations link to nothing at 0.1.
    from_scratch: annotation files that are missing are made from tokens first.

    Each stage (names, candidates, links, numbers, clusters) is written once to the shared folder, as the next ones use it
    several times: texts are read and expanded once whatever reads the answers how often.
    """
    if from_scratch:
        annotated_files(spark, base, year)
    root = store.folder(spark)
    m = store.written(expanded_mentions(spark, base, year, sports), root, "mentions")
    priors = candidates.anchor_priors(spark.read.parquet(f"{base}/anchors"))
    if exists(spark, f"{base}/link_{year}.model"):
        weights, intercept = readers.linear_model(spark, f"{base}/link_{year}.model")
        scored = model_candidates(m, store.written(priors, root, "priors"), knowledge_base(spark, base), weights, intercept)
    else:
        scored = scored_candidates(m, priors)
    scored = store.written(scored, root, "scored")
    out = linking.link(m, scored, knowledge_base(spark, base)).select("pos", "query_id", "name", "entity", "kb_link", "confidence")
    return store.written(nil.cluster_exact(store.written(out, root, "numbered")), root, "answers")


def run_linker(spark: SparkSession, base: str, year: str, output: str, human_readable: bool = False, sports: bool = False, from_scratch: bool = False) -> None:
    """Writes the year's answers as they are submitted, or to be read."""
    answers = link(spark, base, year, sports, from_scratch)
    if human_readable:
        writers.write_tsv(writers.human_readable(answers, queries(spark, base, year), knowledge_base(spark, base)), output)
    else:
        writers.write_lines(writers.submission(answers), output)


def run_benchmark(spark: SparkSession, base: str, year: str, output: str | None = None, by: str = "system", answers: str | None = None, sports: bool = False, from_scratch: bool = False) -> DataFrame:
    """(metric, value) of the year's answers against the gold ones; the report by query goes to output. answers: a file of answers in place of a run of the linker."""
    system = readers.answers_tsv(spark, answers) if answers else link(spark, base, year, sports, from_scratch)
    gold = readers.answers_tsv(spark, f"{base}/answers_{learning.checked_year(year)}.tab")
    if output:
        writers.write_lines(evaluate.report(system, gold, by).withColumnRenamed("line", "value"), output)
    return evaluate.summary(system, gold)


def link_rows(spark: SparkSession, base: str, year: str) -> DataFrame:
    """The labelled candidates of a year's training file, with the features of the link classifier."""
    q = queries(spark, base, year)
    priors = candidates.anchor_priors(spark.read.parquet(f"{base}/anchors"))
    kb = knowledge_base(spark, base).select(F.col("title").alias("kb_name"), "intro")
    c = priors.join(kb, "kb_name", "left").withColumn("intro", F.coalesce("intro", F.lit("")))
    rows = learning.labelled_candidates(readers.link_training(spark, f"{base}/training_{year}.csv"), q, c)
    own, theirs = context_terms(F.col("context")), context_terms(F.col("intro"))
    return with_docsim(rows.withColumns({"own": own, "theirs": theirs, "year": F.lit(year)}))


def link_threshold(spark: SparkSession, base: str) -> float:
    """The mean of the best thresholds of ten deals over both training years."""
    rows = link_rows(spark, base, "2011").union(link_rows(spark, base, "2012"))
    return learning.threshold_search(rows.withColumn("key", F.concat_ws("|", "year", "query_id", "kb_name")), "key").agg(F.avg("threshold")).first()[0]


def link_model(spark: SparkSession, base: str, year: str) -> tuple[dict[str, float], float]:
    """The link classifier for a year, trained on the years that it may be (see learning.TRAINED_ON)."""
    out = None
    for y in learning.training_years(year):
        one = link_rows(spark, base, y)
        out = one if out is None else out.union(one)
    return learning.train_links(out)


def nil_statistics(spark: SparkSession, report: str, base: str, year: str) -> DataFrame:
    """Share of report lines by outcome whose entity is among the document's entities."""
    r = readers.benchmark_report(spark, report)
    e = readers.named_entities(spark, f"{base}/entities_{year}").select("query_id", F.concat("orgs", "locs", "people").alias("entities"))
    return evaluate.shared_entities(r.join(e, "query_id"))
