"""An index of the strings that entities are called by, met by strings that may be misspelt.

A string within d edits of an alias leaves one of any d + 1 parts of the alias whole, and one with as many edits before it as parts at most, and so after it.
So aliases are kept by their parts, strings ask for the parts that an alias of each length near theirs would have, and
only pairs that share one are compared. Nothing here pairs all strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store
from .candidates import ranked

#: Edits that a string may have, by its length: the first number for strings of at least so many characters.
EDITS = ((9, 2), (5, 1), (0, 0))
MOST = max(d for _, d in EDITS)


def allowed_edits(string: Column) -> Column:
    out = None
    for least, d in EDITS:
        out = F.when(F.length(string) >= least, d) if out is None else out.when(F.length(string) >= least, d)
    return out


def _starts(length: Column, parts: int) -> list[Column]:
    """Where the parts of a string begin, counted from 0; lengths differ by one at most, and the end comes last."""
    return [F.floor(length * i / parts).cast("int") for i in range(parts)] + [length.cast("int")]


def indexed(aliases: DataFrame, alias: str) -> DataFrame:
    """(surface, edits, n, part, piece): each distinct alias by its parts, for every number of edits; null and empty ones are left out."""
    a = aliases.select(F.col(alias).alias("surface")).where(F.length(alias) > 0).distinct().withColumn("n", F.length("surface"))
    rows = []
    for d in range(MOST + 1):
        at = _starts(F.col("n"), d + 1)
        rows += [F.struct(F.lit(d).alias("edits"), F.lit(i).alias("part"), F.substring("surface", at[i] + 1, at[i + 1] - at[i]).alias("piece")) for i in range(d + 1)]
    return a.select("surface", "n", F.explode(F.array(*rows)).alias("__p")).select("surface", "n", "__p.*")


def asked(strings: DataFrame, string: str) -> DataFrame:
    """(string, edits, n, part, piece): what a string asks an indexed() table for: parts of aliases of each length near its own, at the places where one of them must be."""
    s = strings.select(F.col(string).alias("string")).where(F.length(string) > 0).distinct().withColumn("edits", allowed_edits(F.col("string")))
    s = s.withColumn("n", F.explode(F.expr("sequence(greatest(length(string) - edits, 1), length(string) + edits)")))
    s = s.withColumn("part", F.explode(F.expr("sequence(0, edits)"))).withColumn("parts", F.col("edits") + 1)
    from_ = F.floor(F.col("n") * F.col("part") / F.col("parts")).cast("int")
    to = F.floor(F.col("n") * (F.col("part") + 1) / F.col("parts")).cast("int")
    s = s.withColumns({"from": from_, "size": to - from_, "more": F.expr("length(string) - n")})
    # Of the parts that stay whole one has at most as many edits before it as parts, and at most as many after it as parts.
    s = s.withColumn("at", F.explode(F.expr("filter(sequence(-part, part), x -> abs(x - more) <= edits - part)")))
    s = s.withColumn("at", F.col("from") + F.col("at")).where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.length("string")))
    return s.select("string", "edits", "n", "part", F.substring("string", F.col("at") + 1, F.col("size")).alias("piece")).distinct()


def near(strings: DataFrame, string: str, aliases: DataFrame, alias: str) -> DataFrame:
    """(string, surface, edits): the aliases within allowed_edits() of each distinct string, with the number of edits.

    Nulls and empty strings meet nothing; lengths and edits are in characters. Strings and aliases are written as they
    are asked for and kept, so that a part that very many share is split.
    """
    spark = strings.sparkSession
    root = store.folder(spark)
    left, right = store.written(asked(strings, string), root, "asked"), store.written(indexed(aliases, alias), root, "indexed")
    met = left.join(right, ["edits", "n", "part", "piece"])
    # A pair that shares several parts is compared for each of them, which costs less than to shuffle it first.
    found = met.withColumn("found", F.levenshtein("string", "surface", MOST)).where("found between 0 and edits")
    return found.groupBy("string", "surface").agg(F.first("found").alias("edits"))


def retrieved(strings: DataFrame, string: str, priors: DataFrame) -> DataFrame:
    """(string, surface, kb_name, edits, candidate_score): entities of the aliases near a string, by priors(surface, kb_name,
    candidate_score). A score falls with the share of the string that is edited; an entity that several aliases suggest is
    taken by its best one, and of equal ones by the fewest edits, then the first alias."""
    met = near(strings, string, priors, "surface").join(priors, "surface")
    score = F.col("candidate_score") * (1 - F.col("edits") / F.greatest(F.length("string"), F.length("surface")))
    best = F.struct((-score).alias("s"), "edits", "surface")
    top = met.groupBy("string", "kb_name").agg(F.min(best).alias("b"))
    return top.select("string", F.col("b.surface").alias("surface"), "kb_name", F.col("b.edits").alias("edits"), (-F.col("b.s")).alias("candidate_score"))


def top_candidates(strings: DataFrame, string: str, priors: DataFrame, k: int = 10) -> DataFrame:
    """retrieved(), the best k of each string, with rank."""
    return ranked(retrieved(strings, string, priors), ["string"], "candidate_score").where(F.col("rank") <= k)
