"""Line deduplication over a whole corpus, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import BLANKS, ascii_lower, sha256_hex


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, min_chars: int = 10, max_docs: int = 1) -> DataFrame:
    """(doc_id, text_hash, drops): the sorted positions of the lines that go, for each text that loses any.

    A line's key has no blanks at its ends and A-Z lower-cased; keys travel as two 64-bit hashes. The documents of a key
    are counted before any join, with partial sums, so that a line which every document holds costs a row for each task.
    """
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    scratch = Scratch(docs.sparkSession)
    at = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(_lines(F.col("text"))).alias("pos", "line"))
    at = at.withColumn("key", key).where(F.length("key") >= min_chars)
    at = at.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    if max_docs == 1:
        counts = at.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last")
    else:
        counts = at.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where(F.col("n") > max_docs)
    # Written, so that the join can split a line that very many documents have.
    counts = scratch.put(counts.select("h1", "h2", "keeper"))
    gone = at.join(counts, ["h1", "h2"]).where("doc_id <> keeper")
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, max_docs: int = 1) -> DataFrame:
    """docs(doc_id, text, ...) -> docs with `text` rebuilt from the lines that stay, and n_lines, n_dropped.

    A line whose key has at least min_chars code points and stands in over max_docs documents stays only in the smallest
    doc_id that holds it (there in every place). Null and empty texts are one empty line, and come back empty. Rows with
    a null doc_id keep all lines and count for none; repeated rows are one document and come back each. All other
    columns come back as they were, `n_lines` and `n_dropped` excepted.
    """
    drops = dropped_lines(docs, min_chars, max_docs).toDF("__id", "__hash", "__drops").hint("shuffle_hash")
    kept = docs.join(drops, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    lines, gone = F.col("__lines"), F.coalesce("__drops", F.array().cast("array<int>"))
    # The lines between one dropped position and the next, so that the work is linear in the number of lines.
    since = F.concat(F.array(F.lit(-1)), gone)
    runs = F.zip_with(since, F.concat(gone, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    kept = kept.withColumn("__lines", _lines(F.col("text"))).withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": F.size(gone).cast("long")})
    text = F.when(F.col("n_dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    return kept.withColumn("text", text).drop("__id", "__hash", "__drops", "__lines")


def digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


ORACLE = r"""
with l as (
  select doc_id, i, s[i] as line, lower_ascii as key from (
    select doc_id, s, unnest(range(1, len(s) + 1)) as i from (
      select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents))
  , lateral (select translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii)
), k as (
  select key, min(doc_id) as keeper from l where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), f as (
  select l.doc_id, l.i, l.line, coalesce(k.keeper <> l.doc_id, false) as gone from l left join k on l.key = k.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from f group by doc_id
"""
