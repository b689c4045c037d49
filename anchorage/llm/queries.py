"""One query for each operator: production parameters, whole tables, the columns agreed for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import changes, chat, decontam, html, kmeans, lines, mixing, paragraphs, pii, quality, simhash, suffix, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_table(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(_table(spark, sf_dir, "documents")).drop("kept", "spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_hash")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.dedup_paragraphs(_table(spark, sf_dir, "documents")).drop("kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.digest(kmeans.cluster(_table(spark, sf_dir, "embeddings")))


def op12_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.sales_changes(_table(spark, sf_dir, "sale_lines"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.formatted_conversations(chat.with_probe(_table(spark, sf_dir, "conversations"))))


OPERATORS = (
    op1_simhash, op2_line_dedup, op3_suffix_array, op4_quality, op5_mixing, op6_html_extraction, op7_paragraph_dedup, op8_decontamination, op9_top_k, op10_pii,
    op11_centroids, op12_change_points, op13_chat_format,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
#: Where SQL can state the whole operator; the others are tested against brute force.
ORACLE = {"op2_line_dedup": lines.ORACLE, "op8_decontamination": decontam.ORACLE, "op9_top_k": topk.ORACLE, "op11_centroids": kmeans.ORACLE, "op13_chat_format": chat.ORACLE}
