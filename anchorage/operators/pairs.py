"""Samples of mention pairs, drawn by their numbers: no pair that is not drawn is ever made."""

from __future__ import annotations

import bisect
import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import store

#: Buckets over which the links are dealt, whose sums come to the driver; mentions of a link that are numbered together.
BUCKETS, STRETCH = 256, 1 << 16
_WIDE = "decimal(38,0)"


def _drawn(rng: random.Random, k: int, n: int) -> list[int]:
    """k distinct numbers below n, ascending."""
    if k * 4 > n:
        return sorted(rng.sample(range(n), k))
    out: set[int] = set()
    while len(out) < k:
        out.add(rng.randrange(n))
    return sorted(out)


def _placed(numbers: list[int], sizes: list[int]) -> list[tuple[int, int]]:
    """(bucket, number within it) of each number, of buckets with so many each."""
    ends = list(accumulate(sizes))
    at = [bisect.bisect_right(ends, x) for x in numbers]
    return [(b, x - (ends[b] - sizes[b])) for b, x in zip(at, numbers, strict=True)]


def _within(o: int) -> tuple[int, int]:
    """The o-th pair (i, j), i < j, in the order of j and then i."""
    j = (1 + math.isqrt(1 + 8 * o)) // 2
    return o - j * (j - 1) // 2, j


def sample_pairs(mentions: DataFrame, seed: int = 0, negatives: int = 10, limit: int = 3000) -> DataFrame:
    """mentions(query_id, kb_link, ...) -> (a, b, label), a before b: a random sample of the pairs with one link (label) and of
    those with two, `negatives` times as many of these as there are of those, of which `limit` pairs at most are kept.

    Links have an order and so have the mentions of a link, so every pair within a link, and every pair across two, has a
    number. Numbers are drawn on the driver (at most `limit`) and unranked: first to a bucket of links by the buckets'
    sums, then to a link by running sums within the bucket, then to mentions by running counts over stretches of the link.
    Each step joins the drawn numbers, a bounded broadcast, with counts; mentions are numbered only in stretches that
    were hit. The shares of both labels are those of the whole. Mentions without an id or link take no part; rows that
    repeat are mentions of their own.
    """
    spark = mentions.sparkSession
    root = store.folder(spark)
    rows = store.written(mentions.select(F.col("query_id").cast("string").alias("query_id"), F.col("kb_link").cast("string").alias("kb_link")).where("query_id is not null and kb_link is not null"), root, "rows")
    links = rows.groupBy("kb_link").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("kb_link"), F.lit(BUCKETS)).cast("int"))
    links = store.written(links, root, "links")
    square = F.sum(F.col("n").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
    heads = {r["bucket"]: r for r in links.groupBy("bucket").agg(F.sum("n").alias("n"), square.alias("nn"), F.max("n").alias("most")).collect()}
    sizes = [heads[b]["n"] if b in heads else 0 for b in range(BUCKETS)]
    squares = [int(heads[b]["nn"]) if b in heads else 0 for b in range(BUCKETS)]
    total, base = sum(sizes), [0, *accumulate(sizes)]
    own = [(q - n) // 2 for n, q in zip(sizes, squares, strict=True)]
    other = [(n * n - q) // 2 + n * (total - base[b] - n) for b, (n, q) in enumerate(zip(sizes, squares, strict=True))]
    schema = "a string, b string, label boolean"
    most = min(negatives * sum(own), sum(other))
    if not (size := min(limit, sum(own) + most)):
        return spark.createDataFrame([], schema)
    rng = random.Random(seed)
    alike = round(size * sum(own) / (sum(own) + most))
    drawn = [(True, *x) for x in _placed(_drawn(rng, alike, sum(own)), own)] + [(False, *x) for x in _placed(_drawn(rng, size - alike, sum(other)), other)]

    # Running sums over the links of a bucket: mentions, pairs within a link, pairs of its mentions with those of later links.
    w = Window.partitionBy("bucket").orderBy("kb_link").rowsBetween(Window.unboundedPreceding, 0)
    bases = spark.createDataFrame(list(enumerate(base[:-1])), "bucket int, base long")
    run = links.join(F.broadcast(bases), "bucket").withColumn("stop", F.col("base") + F.sum("n").over(w))
    run = run.withColumns({"same": (F.col("n") * (F.col("n") - 1) / 2).cast(_WIDE), "cross": (F.col("n").cast("decimal(19,0)") * (total - F.col("stop")).cast("decimal(19,0)")).cast(_WIDE)})
    run = store.written(run.withColumns({"same_stop": F.sum("same").over(w).cast(_WIDE), "cross_stop": F.sum("cross").over(w).cast(_WIDE)}), root, "run")

    def located(wanted: list[tuple], stop: str, each: str) -> dict:
        """The link in which each wanted (no, bucket, at) lies, and how far in it."""
        asked = spark.createDataFrame([(no, b, str(at)) for no, b, at in wanted], "no int, bucket int, at string").withColumn("at", F.col("at").cast(_WIDE))
        hit = (F.col("at") < F.col(stop)) & (F.col("at") >= F.col(stop) - F.col(each))
        got = run.join(F.broadcast(asked), "bucket").where(hit).select("no", "kb_link", "n", F.col("stop").alias("end"), (F.col("at") - F.col(stop) + F.col(each)).alias("off"))
        return {r["no"]: r for r in got.collect()}

    first = located([(no, b, at) for no, (same, b, at) in enumerate(drawn) if same], "same_stop", "same")
    first |= located([(no, b, at) for no, (same, b, at) in enumerate(drawn) if not same], "cross_stop", "cross")
    picks, second = [], []
    for no, (same, _, _) in enumerate(drawn):
        r, off = first[no], int(first[no]["off"])
        if same:
            picks += [(no, r["kb_link"], x) for x in _within(off)]
        else:
            i, later = divmod(off, total - r["end"])
            picks.append((no, r["kb_link"], i))
            second.append(r["end"] + later)
    where = _placed(second, sizes)
    numbers = [no for no, (same, _, _) in enumerate(drawn) if not same]
    run = run.withColumn("from_base", F.col("stop") - F.col("base"))
    for no, r in located([(no, b, at) for no, (b, at) in zip(numbers, where, strict=True)], "from_base", "n").items():
        picks.append((no, r["kb_link"], int(r["off"])))
    met = _picked(spark, rows, picks, -(-max(r["most"] for r in heads.values()) // STRETCH))
    labels = spark.createDataFrame([(no, same) for no, (same, _, _) in enumerate(drawn)], "no int, label boolean")
    return met.groupBy("no").agg(F.min("query_id").alias("a"), F.max("query_id").alias("b")).join(F.broadcast(labels), "no").select("a", "b", "label")


def _picked(spark, rows: DataFrame, picks: list[tuple[int, str, int]], stretches: int) -> DataFrame:
    """(no, query_id): of each pick the mention with that number in its link."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(stretches)).cast("int").alias("part")
    asked = spark.createDataFrame(picks, "no int, kb_link string, at long")
    dealt = rows.select("kb_link", "query_id", part).join(F.broadcast(asked.select("kb_link").distinct()), "kb_link")
    w = Window.partitionBy("kb_link").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counts = dealt.groupBy("kb_link", "part").agg(F.count("*").alias("c")).withColumn("stop", F.sum("c").over(w))
    found = counts.join(F.broadcast(asked), "kb_link").where("at < stop and at >= stop - c").select("no", "kb_link", "part", (F.col("at") - F.col("stop") + F.col("c")).alias("off"))
    found = spark.createDataFrame(found.collect(), "no int, kb_link string, part int, off long")
    number = F.row_number().over(Window.partitionBy("kb_link", "part").orderBy("query_id")) - 1
    numbered = dealt.join(F.broadcast(found.select("kb_link", "part").distinct()), ["kb_link", "part"]).withColumn("off", number.cast("long"))
    return numbered.join(F.broadcast(found), ["kb_link", "part", "off"]).select("no", "query_id")
