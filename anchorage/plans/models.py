"""Training, scoring and measuring of the classifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The names of the sports features in model files, and the columns that hold them here.
SPORTS_NAMES = {
    "If the context includes a fully specified location string": "context_has_full_location",
    "Length of source context": "context_length",
    "NER location": "ner_location",
    "NER none": "ner_none",
    "NER organization": "ner_organization",
    "NER person": "ner_person",
    "Ratio of Organizations With Locations to Other Organizations": "organizations_with_locations",
    "docsim score": "text_score",
    "proximity of preposition in": "in_proximity",
    "score pattern matches": "score_pattern",
}
#: The weights of the sports sense, by feature.
SPORTS_WEIGHTS = {
    "context_has_full_location": -0.08958264997927144,
    "context_length": 1.1828456228513275,
    "ner_location": -0.48613314276987957,
    "ner_none": -1.1565646512614067e-4,
    "ner_organization": 0.39228958794133695,
    "ner_person": 0.0,
    "organizations_with_locations": -2.2565991340662322e-4,
    "text_score": 2.080317448941906,
    "in_proximity": 0.3265555462107808,
    "score_pattern": 0.0,
}
SPORTS_INTERCEPT, SPORTS_THRESHOLD = 0.0, 0.15


def sports_features(context: Column, name: Column, ner_type: Column, text_score: Column, with_location: Column, full_location: Column) -> dict[str, Column]:
    """The features of the sports sense. The score pattern is a whole-number ratio, as the weights were trained with it."""
    at = F.instr(context, name) - 1
    from_ = F.greatest(at - 30, F.lit(0)) + 1
    found = F.instr(F.substring(context, from_, F.length(context)), " in ")
    in_at = from_ + found - 2
    near = F.when((at >= 0) & (found > 0) & (in_at < at), F.least(F.lit(30.0), (at - in_at).cast("double"))).otherwise(30.0)
    is_type = lambda t: F.coalesce((ner_type == t).cast("double"), F.lit(0.0))
    scores = F.size(F.regexp_extract_all(context, F.lit(r"\s[0-9]{1,2}-[0-9]{1,2}"), F.lit(0)))
    return {
        "context_has_full_location": full_location, "context_length": F.when(F.size(F.split(context, " ")) >= 10, 1.0).otherwise(0.0), "ner_location": is_type("LOCATION"), "ner_none": is_type("None"),
        "ner_organization": is_type("ORGANIZATION"), "ner_person": is_type("PERSON"), "organizations_with_locations": with_location, "text_score": text_score, "in_proximity": near,
        "score_pattern": F.floor(scores / F.greatest(F.length(context), F.lit(1))).cast("double"),
    }


def by_column(weights: Mapping[str, float], names: Mapping[str, str] = SPORTS_NAMES) -> dict[str, float]:
    """The weights of a model file by the columns of their features; an unknown name is an error."""
    if unknown := sorted(set(weights) - set(names) - set(names.values())):
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    return {names.get(k, k): v for k, v in weights.items()}


def sports_sense(candidate: Column, probability: Column, threshold: float = SPORTS_THRESHOLD) -> Column:
    """Null where the mention is no candidate, else whether it is over the threshold."""
    return F.when(candidate, probability > threshold)


def train_logistic(rows: DataFrame, features: Sequence[str], label: str = "label") -> tuple[dict[str, float], float]:
    """(weights, intercept) of a logistic regression over named columns, in the order of their names."""
    names = sorted(features)
    x = VectorAssembler(inputCols=names, outputCol="__x").transform(rows.withColumn("__y", F.col(label).cast("double")))
    m = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=100).fit(x)
    return dict(zip(names, m.coefficients.toArray().tolist(), strict=True)), float(m.intercept)


def ranked_labels(rows: DataFrame, label: str, score: str, tie: str, bins: int = 1000) -> DataFrame:
    """(tie, score, label, rank, positives): running counts down the scores.

    Scores are cut into ranges by their quantiles; counts run within a range and start from the sums of all before it, so no task holds all rows.
    """
    cuts = [c for c in rows.select(F.percentile_approx(score, [i / bins for i in range(1, bins)], 10_000)).first()[0] or []] if bins > 1 else []
    cuts = sorted(set(cuts), reverse=True)
    listed = ", ".join(f"double('{float(c)!r}')" for c in cuts)  # as one text: a thousand single literals take longer than the job
    which = F.size(F.filter(F.expr(f"array({listed})"), lambda c: F.col("score") < c)) if cuts else F.lit(0)
    r = rows.select(F.col(tie).alias("tie"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label")).withColumn("__bin", which)
    sums = r.groupBy("__bin").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    before = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("__p"))
    own = Window.partitionBy("__bin").orderBy(F.desc("score"), "tie").rowsBetween(Window.unboundedPreceding, 0)
    at = r.join(F.broadcast(base), "__bin")  # at most `bins` rows
    return at.select("tie", "score", "label", "__bin", (F.col("__n") + F.count("*").over(own)).alias("rank"), (F.col("__p") + F.sum("label").over(own)).alias("positives"))


def interpolated_precision(rows: DataFrame, label: str, score: str, tie: str, positives_only: bool = False, bins: int = 1000) -> DataFrame:
    """(tie, rank, precision, interpolated, rank_fraction, recall) down the scores; interpolated: the best precision from there on."""
    at = ranked_labels(rows, label, score, tie, bins)
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("p"))
    if positives_only:
        at = at.where("label = 1")
    at = at.withColumn("precision", F.col("positives") / F.col("rank"))
    best = at.groupBy("__bin").agg(F.max("precision").alias("m"))
    later = best.select("__bin", F.max("m").over(Window.orderBy("__bin").rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    down = Window.partitionBy("__bin").orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    at = at.join(F.broadcast(later), "__bin").withColumn("interpolated", F.greatest(F.max("precision").over(down), F.coalesce("__later", F.lit(0.0))))
    return at.crossJoin(F.broadcast(total)).select("tie", "rank", "precision", "interpolated", ((F.col("rank") - 1) / F.col("n")).alias("rank_fraction"), F.try_divide("positives", "p").alias("recall"))  # one row of totals


def best_threshold(rows: DataFrame, label: str, score: str, tie: str, bins: int = 1000) -> DataFrame:
    """One row (threshold, f1): the score from which on calling rows positive has the highest F1, the lowest such."""
    at = ranked_labels(rows, label, score, tie, bins)
    total = rows.agg(F.sum(F.col(label).cast("int")).alias("all"))
    f1 = 2 * F.col("positives") / (F.col("rank") + F.col("all"))
    at = at.crossJoin(F.broadcast(total)).withColumn("f1", f1)  # one row of totals
    return at.agg(F.max(F.struct("f1", "rank", "score")).alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def folds(rows: DataFrame, key: str, k: int = 8, seed: int = 0) -> DataFrame:
    """Adds fold, from 0 to k - 1, by a seeded hash of the key."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))


def cross_validate(rows: DataFrame, features: Sequence[str], label: str, key: str, k: int = 8) -> DataFrame:
    """(fold, n, accuracy) of logistic regressions that each leave one fold out."""
    from ..operators.candidates import logistic

    at, out = folds(rows, key, k), None
    for i in range(k):
        w, b = train_logistic(at.where(F.col("fold") != i), features, label)
        test = at.where(F.col("fold") == i).withColumn("p", logistic(w, {c: F.col(c) for c in features}, b))
        one = test.agg(F.lit(i).alias("fold"), F.count("*").alias("n"), F.avg(((F.col("p") > 0.5) == (F.col(label).cast("int") == 1)).cast("int")).alias("accuracy"))
        out = one if out is None else out.union(one)
    return out


def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("accuracy"))
