"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch
from .text import word_count

#: Bins of equal width in which a group's quotients are counted.
BINS = 4096


def source_targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """sources(source, source_size) -> with `target`, a share of the sum of all sizes by weight, cut at ceiling x size.

    Weights go round over the sources by code point, null last. What a cut leaves over is shared again by weight, until
    no source is above its cut: the least level L such that the sum of least(ceiling x size, L x weight) is the whole.
    Sources are ordered by size / weight, in which order they reach their cut, so each possible L is a prefix sum.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sources.withColumn("__i", F.row_number().over(by_name) - 1)
    w = w.withColumn("__w", F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("__i") % len(weights) + 1).cast("double"))
    cut = (F.col("source_size") * ceiling).cast("double")
    order = Window.orderBy(cut / F.col("__w"), "__i")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cut).over(before), F.lit(0.0))) / F.sum("__w").over(after)
    w = w.withColumn("__level", level)
    # The first source, in order of reaching its cut, that stays below it sets the level for itself and all after it.
    free = F.min(F.when(F.col("__level") * F.col("__w") <= cut, F.struct((cut / F.col("__w")).alias("at"), F.col("__i").alias("i"), F.col("__level").alias("level")))).over(everything)
    w = w.withColumn("__free", free["level"])
    return w.withColumn("target", F.when(F.col("__free").isNull(), cut).otherwise(F.least(cut, F.col("__free") * F.col("__w")))).drop("__i", "__w", "__level", "__free")


def sainte_lague(scratch: Scratch, parties: DataFrame, votes: str, seats: str) -> DataFrame:
    """parties(__g, __key, votes, seats, ...) -> with `quota`: each group's `seats` (the same in all its rows) given to the highest quotients votes / (2a + 1).

    Seats are votes / D rounded for some divisor D, and n parties' roundings add up to n / 2 at most, so a party with the
    share s of the votes ends within s x n / 2 + 1 of votes x seats / sum rounded. Only quotients in that range (and one
    more, for the arithmetic) are bids, at most 8n in a group however many parties it has; those below it are won for
    sure. Bids are counted by bins of their quotient, so that all in the bins above the last seat's win without being
    ordered, and only that one bin is ranked. Ties go to the first key in `__key`. Parties without votes get none.
    """
    sums = scratch.put(parties.groupBy("__g").agg(F.sum(votes).alias("__sum"), F.count("*").alias("__n")))
    share = F.coalesce(F.col(votes) / F.nullif(F.col("__sum"), F.lit(0.0)), F.lit(0.0))
    p = parties.join(sums, "__g").withColumns({"__fair": F.round(share * F.col(seats)).cast("long"), "__slack": (F.ceil(share * F.col("__n") / 2) + 2).cast("long")})
    p = scratch.put(p.withColumn("__base", F.greatest(F.col("__fair") - F.col("__slack"), F.lit(0)).cast("long")).drop("__sum", "__n"))
    based = scratch.put(p.groupBy("__g").agg((F.max(seats) - F.sum("__base")).cast("long").alias("__left")))
    bids = p.where(F.col(votes) > 0).select("__g", "__key", votes, F.explode(F.sequence(F.col("__base"), F.col("__fair") + F.col("__slack"))).alias("__a"))
    bids = scratch.put(bids.select("__g", "__key", "__a", (F.col(votes) / (2 * F.col("__a") + 1)).alias("__q")))
    span = scratch.put(bids.groupBy("__g").agg(F.min("__q").alias("__lo"), F.max("__q").alias("__hi")))
    bin_of = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__q") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BINS)).otherwise(F.lit(0).cast("long"))
    binned = bids.join(span, "__g").select("__g", "__key", "__a", "__q", bin_of.alias("__bin"))
    above = Window.partitionBy("__g").orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    filled = binned.groupBy("__g", "__bin").agg(F.count("*").alias("__in")).withColumn("__above", F.coalesce(F.sum("__in").over(above), F.lit(0)))
    filled = scratch.put(filled.join(based, "__g").where(F.col("__above") < F.col("__left")))
    placed = binned.join(filled, ["__g", "__bin"])
    sure = placed.where(F.col("__above") + F.col("__in") <= F.col("__left"))
    rank = F.row_number().over(Window.partitionBy("__g").orderBy(F.desc("__q"), "__key", "__a"))
    last = placed.where(F.col("__above") + F.col("__in") > F.col("__left")).withColumn("__rank", rank).where(F.col("__rank") <= F.col("__left") - F.col("__above"))
    won = sure.select("__g", "__key").union(last.select("__g", "__key")).groupBy("__g", "__key").agg(F.count("*").alias("__won"))
    out = p.join(won, ["__g", "__key"], "left").withColumn("quota", F.col("__base") + F.coalesce("__won", F.lit(0)))
    return scratch.put(out.drop("__fair", "__slack", "__base", "__won"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), ceiling: int = 3, block: int = 64, shard_rows: int = 4096, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, source, ...) -> (doc_id, size, source_size, target, taken), one row for each row of docs.

    The whole mix is one block of `block` words after another. Sainte-Lague apportionment by highest quotients gives each
    source its number of blocks from the targets, then each shard of a source (about shard_rows documents, dealt by a
    seeded hash) its number from the shards' sizes. Within a shard documents stand in the seeded order; the shard's
    quota runs through them from the first and starts again at the end, so each document is taken whole a number of
    times and one of them in part: `taken` words, at most ceiling x size. Reruns agree, as nothing hangs on row order.

    Sizes count words [^\\x20\\x09-\\x0D]+, 0 for null or empty texts, of which nothing is taken. Documents of the null
    source make one source, the last. Repeated rows each count. An empty table gives no rows. Texts are read in the scan
    only; what is shuffled is a few numbers for each document.
    """
    scratch = Scratch(docs.sparkSession)
    g = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__g")  # never null, and "" for the null source alone
    sized = docs.select("doc_id", g, word_count(F.col("text")).alias("size"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("turn"))
    sized = scratch.put(sized)
    sources = sized.groupBy("__g").agg(F.sum("size").alias("source_size"), F.count("*").alias("__docs"))
    sources = sources.withColumn("source", F.when(F.col("__g") != "", F.substring("__g", 2, 1 << 30)))
    aimed = source_targets(sources, weights, ceiling).drop("source").withColumnRenamed("__g", "__key")
    aimed = aimed.withColumns({"__g": F.lit("all"), "__seats": F.floor(F.sum("source_size").over(Window.partitionBy()) / block)})
    aimed = sainte_lague(scratch, aimed, "target", "__seats").withColumnRenamed("quota", "blocks")
    aimed = aimed.select(F.col("__key").alias("__g"), "source_size", "target", "blocks", F.ceil(F.col("__docs") / shard_rows).alias("__shards"))
    # One row for each source; where a source holds a third of all rows, the join can split it, as its other side is one row.
    shard = F.pmod(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long"), F.col("__shards"))
    dealt = sized.join(aimed, "__g").select("doc_id", "__g", "size", "turn", "source_size", "target", "blocks", shard.alias("shard"))
    shards = dealt.groupBy("__g", "shard").agg(F.sum("size").cast("double").alias("shard_size"), F.first("blocks").alias("blocks")).withColumnRenamed("shard", "__key")
    shards = sainte_lague(scratch, shards, "shard_size", "blocks")
    shards = shards.select("__g", F.col("__key").alias("shard"), (F.col("quota") * block).alias("words"))
    at = dealt.join(shards, ["__g", "shard"])
    own = Window.partitionBy("__g", "shard").orderBy("turn", "doc_id", "size")
    whole = F.sum("size").over(Window.partitionBy("__g", "shard"))
    at = at.withColumns({"__whole": whole, "__before": F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    words = F.least(F.col("words"), F.col("__whole") * ceiling)
    times, rest = F.expr("coalesce(try_divide(__words - mod(__words, greatest(__whole, 1)), greatest(__whole, 1)), 0)").cast("long"), F.expr("mod(__words, greatest(__whole, 1))")
    at = at.withColumn("__words", words).withColumns({"__times": times, "__rest": rest})
    part = F.greatest(F.least(F.col("__rest") - F.col("__before"), F.col("size")), F.lit(0))
    return at.select("doc_id", "size", "source_size", "target", (F.col("__times") * F.col("size") + part).cast("long").alias("taken"))
