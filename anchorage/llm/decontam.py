"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import ascii_lower, sha256_hex

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ said by what it holds, the commonest first: Java tries such a class ten times faster.
WORD = r"[a-z\x80-\x{10FFFF}0-9]+"
#: Prefix rows up to which the benchmark side is sent to every executor; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
#: The same words before lower-casing, for counting.
ANY_CASE = r"[a-z\x80-\x{10FFFF}0-9A-Z]+"


def words(text: Column) -> Column:
    """Words of a text after A-Z lower-casing; [] for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, width: int = 13) -> DataFrame:
    """items(item_id, text, ...) -> (item_id, start, win): `width` consecutive words; all words of a shorter item; no row without words."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return w.select("item_id", "w", F.explode(starts).alias("start")).select("item_id", "start", F.slice("w", F.col("start") + 1, F.lit(width)).alias("win"))


def hits(scratch: Scratch, docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, text_hash, item_id, pos, n): a window of an item stands at word pos of the text and is n words long.

    All tokens are ordered by rarity in docs. Containment of a whole window needs all its tokens, so a prefix of one
    token suffices: its rarest. Windows sharing content share a row. A document word equal to a window's prefix token is
    a candidate; the positional bound (the token's place in the window must leave room on both sides) and then the exact
    comparison of the window's words decide. Common words are prefix tokens only of windows that have no rarer one.
    """
    wins = scratch.put(item_windows(items, width))
    # Words meet as 64-bit hashes, as a join on a long is far cheaper; the exact comparison below makes up for it. The
    # outer explodes keep the optimizer from filtering on the words first, for which it would split each text twice.
    hashed = F.xxhash64("word").alias("wh")
    vocabulary = wins.select(F.explode("win").alias("word")).select(hashed).distinct()
    vocabulary = _small(scratch.put(vocabulary), wins.count() * width)
    tokens = docs.select(F.explode_outer(words(F.col("text"))).alias("word")).select(hashed)
    freq = tokens.join(vocabulary, "wh").groupBy("wh").agg(F.count("*").alias("n"))
    distinct = scratch.put(wins.groupBy("win").agg(F.collect_set("item_id").alias("items")))
    place = distinct.select("win", F.posexplode("win").alias("at", "word")).withColumn("wh", hashed).join(freq, "wh", "left")
    prefix = place.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("wh"), F.col("at"))).alias("p"))
    # A window with a word that no document has cannot occur.
    prefix = scratch.put(prefix.where("p.n > 0").select("win", F.col("p.wh").alias("wh"), F.col("p.at").alias("at")))
    n_prefix = prefix.count()
    at = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    pos = F.col("i") - F.col("at")
    if n_prefix <= BROADCAST_ROWS:
        at = at.select("doc_id", "text_hash", "w", F.posexplode_outer("w").alias("i", "word")).withColumn("wh", hashed)
        found = at.join(F.broadcast(prefix), "wh").where((pos >= 0) & (pos + F.size("win") <= F.size("w")))
        found = found.where(F.slice("w", pos + 1, F.size("win")) == F.col("win")).select("doc_id", "text_hash", "win", pos.alias("pos"))
    else:
        # Words are shuffled alone, as numbers; a text meets its candidates once, and only then its words are compared.
        prefix = prefix.withColumn("window", F.xxhash64("win"))
        alone = at.select("doc_id", "text_hash", F.size("w").alias("size"), F.posexplode_outer("w").alias("i", "word")).select("doc_id", "text_hash", "size", "i", hashed)
        candidates = alone.join(prefix.select("wh", "at", "window", F.size("win").alias("n")), "wh").where((pos >= 0) & (pos + F.col("n") <= F.col("size")))
        candidates = candidates.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(pos.alias("pos"), "n", "window")).alias("c"))
        # The windows that candidates say, taken from the text, against all windows.
        candidates = candidates.toDF("__id", "__hash", "c").hint("shuffle_hash")
        own = at.join(candidates, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("doc_id", "text_hash", "w", F.explode("c").alias("c"))
        own = own.select("doc_id", "text_hash", "c.pos", "c.window", F.expr("slice(w, c.pos + 1, c.n)").alias("win")).where(F.xxhash64("win") == F.col("window")).drop("window").distinct()
        found = own.join(distinct.select("win"), "win")
    return found.join(_small(distinct, n_prefix), "win").select("doc_id", "text_hash", F.explode("items").alias("item_id"), "pos", F.size("win").alias("n"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """docs(doc_id, text, ...), items(item_id, text, ...) -> one row for each row of docs:
    (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), and text_hash to join on.

    n_hit counts the words inside any occurrence of a window of any item; contaminated if it is not 0 and share x n_hit
    reaches n_words. Null and wordless texts have 0 words and are clean; items without words match nothing; items that
    repeat are told apart by item_id only; a null item_id counts for hits but is not listed. Rows of docs are told
    apart by doc_id and text, so repeated rows each get the same answer. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.put(hits(scratch, docs, items, width))
    # A common passage can give one document a row for each item and word: these meet as sets, partly before the shuffle.
    covered = found.select("doc_id", "text_hash", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("i")).distinct()
    covered = covered.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    named = found.where("item_id is not null").select("doc_id", "text_hash", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    by = [F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), F.col("d.text_hash") == F.col("c.text_hash")]
    both = covered.join(named, (covered["doc_id"].eqNullSafe(named["doc_id"])) & (covered["text_hash"] == named["text_hash"]), "left").select(covered["doc_id"], covered["text_hash"], "n_hit", "n_items", "items")
    out = base.alias("d").join(both.alias("c"), by[0] & by[1], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("d.doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        sha256_hex(F.coalesce("items", F.lit(""))).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "d.text_hash")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not contaminated by items (see contamination())."""
    bad = contamination(docs, items, width, share).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, win, len(win) as n from (
    select item_id, array_to_string(w[i:i + 12], ' ') as win_text, w[i:i + 12] as win
    from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0))
), sizes as (select distinct n from bw), dw as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
), h as (
  select dw.doc_id, bw.item_id, dw.i, dw.n from dw join (select item_id, n, array_to_string(win, ' ') as win from bw) bw on dw.win = bw.win and dw.n = bw.n
), c as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id
), m as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c on c.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""
