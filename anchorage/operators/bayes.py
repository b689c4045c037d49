"""Naive Bayes over the terms of texts. The model is a table of counts, which is written, read and met by joins; no vocabulary is held by the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

#: A model: the examples of each label (term null), and the weight of each term over them.
MODEL = "label int, term string, weight double"
#: The weight that every term has in either class before it is seen.
SMOOTHING = 0.05
#: How many terms are sent to every task, and how many bytes one of them has at most: some 50 MB.
FREQUENT, LONGEST = 400_000, 64


def train(rows: DataFrame, key: str, terms: str, label: str) -> DataFrame:
    """MODEL of rows(key, terms array<string>, label: boolean or 0 and 1); rows without a label take no part. Adds up partial sums of each class, not of each row."""
    known = rows.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("int"))
    each = known.select("label", F.size(terms).alias("__n"), F.explode(terms).alias("term")).where("term is not null")
    weights = each.groupBy("label", "term").agg(F.sum(F.lit(1.0) / F.col("__n")).alias("weight"))
    return known.groupBy("label").agg(F.count("*").cast("double").alias("weight")).select("label", F.lit(None).cast("string").alias("term"), "weight").union(weights)


def save(model: DataFrame, path: str) -> None:
    model.select("label", "term", "weight").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def term_odds(model: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(term, odds, log_true, mass): log odds of label 1 for one more of a term, and the log of its share in label 1; where term is null, of the classes themselves."""
    side = lambda i: F.coalesce(F.sum(F.when(F.col("label") == i, F.col("weight"))), F.lit(0.0))
    by_term = model.groupBy("term").agg(side(0).alias("no"), side(1).alias("yes"))
    is_term = F.col("term").isNotNull()
    of = lambda c: F.coalesce(F.sum(F.when(is_term, F.col(c))), F.lit(0.0))
    total = model.withColumns({"no": F.when(F.col("label") == 0, F.col("weight")), "yes": F.when(F.col("label") == 1, F.col("weight"))})
    total = total.agg(of("no").alias("all_no"), of("yes").alias("all_yes"), F.countDistinct("term").alias("size"), *[F.coalesce(F.sum(F.when(~is_term, F.col(c))), F.lit(0.0)).alias(f"n_{c}") for c in ("no", "yes")])
    at = by_term.crossJoin(F.broadcast(total))  # one row of totals
    s = F.lit(float(smoothing))
    log = lambda c: F.ln(F.when(is_term, (F.col(c) + s) / (F.col(f"all_{c}") + s * F.col("size"))).otherwise((F.col(f"n_{c}") + s) / (F.col("n_no") + F.col("n_yes") + 2 * s)))
    return at.select("term", (log("yes") - log("no")).alias("odds"), log("yes").alias("log_true"), (F.col("yes") + F.col("no")).alias("mass"))


def frequent(odds: DataFrame, most: int = FREQUENT) -> tuple[DataFrame, bool]:
    """The terms of greatest mass, at most so many and of at most LONGEST bytes each, and whether these are all. Whole bins of mass are taken, of which the driver sees the counts."""
    bins = odds.where(F.octet_length("term") <= LONGEST).withColumn("__bin", F.floor(4 * F.log2(F.greatest("mass", F.lit(1e-12)))))
    least, n = None, 0
    for at, more in sorted(((r[0], r[1]) for r in bins.groupBy("__bin").count().collect()), reverse=True):
        if n + more > most:
            break
        least, n = at, n + more
    chosen = bins.where(F.col("__bin") >= least if least is not None else F.lit(False)).drop("__bin")
    return chosen, n == odds.where("term is not null").count()


def scored(rows: DataFrame, key: str, terms: str, model: DataFrame, smoothing: float = SMOOTHING, most: int = FREQUENT) -> DataFrame:
    """rows with text_log, the log of label 1 and the text together, and text_score, the probability of label 1.

    Terms that the model lacks count nothing, so a row without known terms has what the classes themselves have. An empty
    model gives even odds. The frequent terms, a bounded number, are sent to the texts and added up where these lie: a text
    leaves its task as one row, and one for each distinct term that is not among them; only those are shuffled to their odds.
    """
    spark = rows.sparkSession
    root = store.folder(spark)
    odds = store.written(term_odds(model, smoothing), root, "odds")
    known, whole = frequent(odds, most)
    each = rows.select(F.col(key).alias("__key"), F.size(terms).alias("__n"), F.explode(terms).alias("term")).where("term is not null")
    part = lambda c: F.sum(F.col(c) / F.col("__n"))
    if whole:
        sums = each.join(F.broadcast(known), "term").groupBy("__key").agg(part("odds").alias("__odds"), part("log_true").alias("__log"))
    else:
        met = each.join(F.broadcast(known), "term", "left").withColumn("rare", F.when(F.col("mass").isNull(), F.col("term")))
        met = met.groupBy("__key", "rare").agg(part("odds").alias("o"), part("log_true").alias("l"), F.sum(1 / F.col("__n")).alias("w"))
        met = store.written(met, root, "met")
        rest = odds.where("term is not null").join(known.select("term"), "term", "left_anti")
        rare = met.where("rare is not null").join(rest, F.col("rare") == F.col("term"))
        rare = rare.select("__key", (F.col("w") * F.col("odds")).alias("o"), (F.col("w") * F.col("log_true")).alias("l"))
        sums = met.where("rare is null").select("__key", "o", "l").union(rare).groupBy("__key").agg(F.sum("o").alias("__odds"), F.sum("l").alias("__log"))
    start = odds.where("term is null").agg(F.coalesce(F.max("odds"), F.lit(0.0)).alias("__o"), F.coalesce(F.max("log_true"), F.ln(F.lit(0.5))).alias("__l"))
    out = rows.join(sums, F.col(key) == F.col("__key"), "left").crossJoin(F.broadcast(start))  # one row
    z = F.col("__o") + F.coalesce("__odds", F.lit(0.0))
    return out.withColumns({"text_log": F.col("__l") + F.coalesce("__log", F.lit(0.0)), "text_score": 1 / (1 + F.exp(-z))}).drop("__key", "__odds", "__log", "__o", "__l")
