"""Evaluation of links against gold answers: outcome classes, B-cubed scores, over-clustering, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(system: DataFrame, gold: DataFrame) -> DataFrame:
    s = system.select("query_id", F.col("kb_link").alias("sys"))
    return s.join(gold.select("query_id", F.col("kb_link").alias("gold")), "query_id")


def missing(system: DataFrame, gold: DataFrame) -> DataFrame:
    """Queries that only one side answers; an evaluation is complete if there are none."""
    a, b = system.select("query_id"), gold.select("query_id")
    return a.join(b, "query_id", "left_anti").withColumn("side", F.lit("system")).union(b.join(a, "query_id", "left_anti").withColumn("side", F.lit("gold")))


def with_cluster_sizes(both: DataFrame) -> DataFrame:
    """Adds n_sys, n_gold and n_both, the sizes of a query's clusters and of their overlap.

    Counts are aggregated before they are joined, so no task holds the members of a cluster.
    """
    n_both = both.groupBy("sys", "gold").agg(F.count("*").alias("n_both"))
    n_sys = n_both.groupBy("sys").agg(F.sum("n_both").alias("n_sys"))
    n_gold = n_both.groupBy("gold").agg(F.sum("n_both").alias("n_gold"))
    return both.join(n_both, ["sys", "gold"]).join(n_sys, "sys").join(n_gold, "gold")


def outcomes(system: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, sys, gold, outcome): the first rule that holds. A NIL is right if its cluster is the gold cluster."""
    m = with_cluster_sizes(_joined(system, gold))
    sys_kb, gold_kb = F.startswith("sys", F.lit("E")), F.startswith("gold", F.lit("E"))
    same = (F.col("n_sys") == F.col("n_both")) & (F.col("n_gold") == F.col("n_both"))
    rule = (
        F.when(sys_kb & gold_kb & (F.col("sys") == F.col("gold")), "CORRECT").when(sys_kb & gold_kb, "WRONG KB ID")
        .when(~sys_kb & gold_kb, "EXP KB ID").when(sys_kb & ~gold_kb, "EXP NIL").when(same, "NIL OK").otherwise("WRONG NIL ID")
    )
    return m.select("query_id", "sys", "gold", rule.alias("outcome"))


def outcome_counts(system: DataFrame, gold: DataFrame) -> DataFrame:
    return outcomes(system, gold).groupBy("outcome").agg(F.count("*").alias("n"))


def b_cubed_terms(system: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, precision, recall) of each query. Whether a pair counts hangs on the link of its first member only, so
    both are ratios of cluster sizes and no pair is ever formed."""
    m = with_cluster_sizes(_joined(system, gold))
    right = F.when(F.startswith("gold", F.lit("E")), F.col("sys") == F.col("gold")).otherwise(F.startswith("sys", F.lit("NIL")))
    ok = F.when(right, F.lit(1.0)).otherwise(F.lit(0.0))
    return m.select("query_id", (ok * F.col("n_both") / F.col("n_sys")).alias("precision"), (ok * F.col("n_both") / F.col("n_gold")).alias("recall"))


def b_cubed(system: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (precision, recall, f1); f1 is null where both are 0."""
    t = b_cubed_terms(system, gold).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    return t.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def over_clustered(system: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: how many system clusters hold queries of several gold clusters."""
    per = _joined(system, gold).groupBy("sys", "gold").agg(F.lit(1)).groupBy("sys").agg(F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("over_clustered"))


def report(system: DataFrame, gold: DataFrame, by: str = "system") -> DataFrame:
    """(line) of each query, ordered by system cluster, gold cluster or query."""
    o = outcomes(system, gold)
    tail = F.when(F.contains("outcome", F.lit("KB ID")), F.concat(F.lit("\tEXPECTED "), F.col("gold"))).otherwise(F.lit(""))
    order = {"system": ["sys", "query_id"], "gold": ["gold", "query_id"], "query": ["query_id"]}[by]
    return o.orderBy(*order).select(F.concat(F.concat_ws("\t", "outcome", "query_id", "sys"), tail).alias("line"))


def summary(system: DataFrame, gold: DataFrame) -> DataFrame:
    """(metric, value): the six outcome counts, over-clustering and B-cubed scores."""
    names = ["CORRECT", "WRONG KB ID", "EXP KB ID", "EXP NIL", "WRONG NIL ID", "NIL OK"]
    counts = outcome_counts(system, gold).select(F.col("outcome").alias("metric"), F.col("n").cast("double").alias("value"))
    base = system.sparkSession.createDataFrame([(n,) for n in names], "metric string").join(counts, "metric", "left").fillna(0.0)
    over = over_clustered(system, gold).select(F.lit("over_clustered").alias("metric"), F.col("over_clustered").cast("double").alias("value"))
    b = b_cubed(system, gold).selectExpr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, value)")
    return base.union(over).union(b)


def shared_entities(rows: DataFrame) -> DataFrame:
    """rows(outcome, name, entity, entities array) -> share of rows by outcome whose entity differs from the name and is among the entities."""
    hit = (F.col("name") != F.col("entity")) & F.array_contains("entities", F.col("entity"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("share"))
