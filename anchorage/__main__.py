"""Command line: python -m anchorage TOOL --base-dir FOLDER ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import annotations, candidates, surface
from .plans import learning, system
from .sources import readers, writers


def _show(df) -> None:
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def _link(spark, a):
    system.run_linker(spark, a.base_dir, a.year, a.output, a.human_readable, a.sports_classify, a.from_scratch)


def _benchmark(spark, a):
    _show(system.run_benchmark(spark, a.base_dir, a.year, a.output, a.sort, a.answers, a.sports_classify, a.from_scratch))


def _readable(spark, a):
    answers = readers.answers_tsv(spark, a.answers)
    q = system.queries(spark, a.base_dir, a.year)
    out = answers.join(q.select("query_id", "name", F.col("name").alias("entity")), "query_id")
    writers.write_tsv(writers.human_readable(out, q, system.knowledge_base(spark, a.base_dir)), a.output)


def _link_threshold(spark, a):
    print(system.link_threshold(spark, a.base_dir))


def _link_model(spark, a):
    writers.write_lines(writers.linear_model_lines(spark, *system.link_model(spark, a.base_dir, a.year)), a.output)


def _sports_text(spark, a):
    system.train_sports_text(spark, a.base_dir, a.year)


def _link_precision(spark, a):
    rows = system.link_rows(spark, a.base_dir, "2011").union(system.link_rows(spark, a.base_dir, "2012")).withColumn("key", F.concat_ws("|", "query_id", "kb_name"))
    writers.write_lines(learning.cross_year(rows, "2012", "2011", "key").orderBy("rank").select(F.col("line").alias("value")), a.output)


def _augment(spark, a):
    training = readers.link_training(spark, f"{a.base_dir}/training_{a.year}.csv")
    writers.write_lines(learning.augmented_lines(training, candidates.ambiguity(training, "used", system.knowledge_base(spark, a.base_dir))), a.output)


def _nil_statistics(spark, a):
    _show(system.nil_statistics(spark, a.answers, a.base_dir, a.year))


def _annotate(spark, a):
    system.annotated_files(spark, a.base_dir, a.year)


def _chains(spark, a):
    t = spark.read.parquet(f"{a.base_dir}/tokens_{a.year}")
    m = t.where("chain is not null").groupBy("doc_id", "chain", "sent").agg(F.min("idx").alias("from_idx"), (F.max("idx") + 1).alias("to_idx"))
    return annotations.chain_of(system.queries(spark, a.base_dir, a.year).select("query_id", "doc_id", "beg", "end"), annotations.mention_spans(m, t))


def _mentions(spark, a):
    writers.write_lines(writers.mention_lines(_chains(spark, a)), a.output)


def _representatives(spark, a):
    writers.write_lines(writers.representative_lines(_chains(spark, a)), a.output)


def _types(spark, a):
    writers.write_lines(writers.type_lines(readers.named_entities(spark, f"{a.base_dir}/entities_{a.year}")), a.output)


def _alternates(spark, a):
    m = annotations.with_entities(system.queries(spark, a.base_dir, a.year), readers.named_entities(spark, f"{a.base_dir}/entities_{a.year}")).drop("error_reason")
    m = m.withColumns({"spans": F.array().cast("array<struct<start:int,end:int>>"), "sports": F.lit(None).cast("boolean")})
    writers.write_lines(writers.alternate_lines(surface.entity_strings(m, system.gazetteer_of(spark, a.base_dir)[0])), a.output)


def _gazetteer(spark, a):
    _show(readers.gazetteer(spark, f"{a.base_dir}/gazetteer.txt")[1].orderBy("container", "city"))


def _kb_maps(spark, a):
    from .functions import text as tx

    kb = readers.kb_xml(spark, a.answers).withColumns({"intro": tx.intro("text"), "first_paragraph": tx.first_paragraphs("text"), "structured_type": F.col("entity_type")})
    writers.kb_maps(kb, a.output)


#: Tool, what it does, and whether it writes to --output.
TOOLS = {
    "link": (_link, "link a year's queries"), "benchmark": (_benchmark, "evaluate answers, of a file or of a run of the linker"), "readable": (_readable, "answers with contexts and titles"),
    "link-threshold": (_link_threshold, "mean of the best thresholds of ten deals"), "link-model": (_link_model, "train the link classifier for a year"), "link-precision": (_link_precision, "precision by rank, one year by the other"),
    "sports-text": (_sports_text, "train the text model of the sports sense and keep it in the base folder"), "augment-training": (_augment, "training lines with the ambiguity of their strings"), "nil-statistics": (_nil_statistics, "shares of entities by outcome, of a report"), "annotate": (_annotate, "make missing annotation files"),
    "mentions": (_mentions, "strings of each query's chain"), "representatives": (_representatives, "longest mention of each chain"), "types": (_types, "types and matching entities"),
    "alternates": (_alternates, "fullest names of mentions"), "gazetteer": (_gazetteer, "places and what lies in them"), "kb-maps": (_kb_maps, "maps of a knowledge base, from its XML files"),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="anchorage", description="\n".join(f"{k}: {d}" for k, (_, d) in TOOLS.items()), formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("tool", choices=TOOLS)
    p.add_argument("--base-dir", default=".", help="folder of inputs (see anchorage/plans/system.py)")
    p.add_argument("--year", default="2012", choices=learning.YEARS)
    p.add_argument("--output", help="where lines are written")
    p.add_argument("--answers", help="a file of answers, a report, or the files of a knowledge base")
    p.add_argument("--sort", default="system", choices=("system", "gold", "query"), help="order of a report")
    p.add_argument("--human-readable", action="store_true")
    p.add_argument("--sports-classify", action="store_true")
    p.add_argument("--from-scratch", action="store_true", help="make missing annotation files first")
    a = p.parse_args(argv)
    TOOLS[a.tool][0](spark or SparkSession.builder.appName("anchorage").getOrCreate(), a)


if __name__ == "__main__":
    main()
