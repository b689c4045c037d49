"""From raw documents to a training mix: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.llm import decontam, lines, mixing, paragraphs, quality, simhash
from anchorage.llm.components import connected_components
from anchorage.llm.store import Scratch
from anchorage.llm.suffix import row_hash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject.

    Null and empty texts are scored like any other, by what the classifier says of a text without features. Without
    labels to learn from nothing is rejected. Repeated rows have one score, so all or none of them stay.
    """
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has too; n_chars follows the text.

    Null texts come back empty; rows without a doc_id keep their lines; repeated rows are one document and come back each.
    """
    out = lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, and all that have no doc_id.

    The SimHash operator links fingerprints of 5-word shingles that differ in at most 3 bits, which is a Jaccard similarity
    of some 0.98. Texts at 0.8 differ in 10 bits on average, a radius at which a tree over 64 bits prunes nothing, so
    these are linked by MinHash bands and an exact similarity of 0.8 or more; groups are components of both kinds of links.
    Null and empty texts are texts without words, copies of each other. Rows with the same doc_id and different texts are
    documents each; rows equal in both are one, which stays or goes with all its rows.
    """
    scratch = Scratch(spark)
    own = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = scratch.put(simhash.fingerprints(own.select(F.struct("doc_id", row_hash().alias("th")).alias("doc_id"), "text"), width=5))
    near = scratch.put(simhash.grouped(scratch, hashed).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    alike = scratch.put(paragraphs.near_copies(scratch, own).select(F.struct("doc_id", "th").alias("a"), F.col("first").alias("b")))
    comp = connected_components(scratch, near.union(alike)).where("node <> component")
    gone = scratch.put(comp.select(F.col("node.doc_id").alias("__id"), F.col("node.th").alias("__th")))
    text = F.coalesce("text", F.lit(""))
    return docs.join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (row_hash(text=text) == F.col("__th")), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves.

    Null and wordless texts hold no window and stay, as all do where the benchmark is empty. Repeated rows stay or go together.
    """
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; of null and empty texts none. The null source is a source; repeated rows count each."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_to_weights),
]

#: SQL expresses neither the trained classifier nor near-duplicate components; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    scratch = Scratch(spark)
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
