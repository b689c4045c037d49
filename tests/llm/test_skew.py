"""Keys that very many rows share: the joins on them are dealt over several tasks."""

import random

import pytest

from anchorage.llm import lines, paragraphs, simhash, suffix

#: With these a partition of a few kilobytes counts as skewed.
CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture()
def splits(spark):
    """A function that says how many plans with a split join have been run since."""
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = store.executionsList()
        return [every.apply(i) for i in range(every.size())]

    # The store keeps a bounded number of executions, so that their places change; their ids grow.
    last = max((x.executionId() for x in executions()), default=-1)

    def count():
        return sum("skew=true" in x.physicalPlanDescription() for x in executions() if x.executionId() > last)

    yield count
    for k, v in before.items():
        spark.conf.set(k, v)


def table(spark, n, hot):
    """n documents of their own words, of which every other one has the hot text in it."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(12)) + (hot(rng) if i % 2 else "")) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


HOT_LINE = " ".join(f"shared{i}" for i in range(30))


def test_line_of_half_of_the_documents(spark, splits):
    assert len(lines.dropped_lines(table(spark, 4000, lambda rng: "\n" + HOT_LINE)).collect()) == 1999
    assert splits() > 0


def test_fingerprint_of_half_of_the_documents(spark, splits):
    rows = table(spark, 4000, lambda rng: "").selectExpr("doc_id", "case when doc_id % 2 = 1 then 'the same text for very many' else text end as text")
    assert simhash.near_duplicates(rows).where("component_id = 1").count() == 2000
    assert splits() > 0


def test_paragraph_of_half_of_the_documents(spark, splits):
    got = paragraphs.dedup_paragraphs(table(spark, 2000, lambda rng: "\n" + HOT_LINE)).where("n_linked > 0")
    assert got.count() == 1000 and splits() > 0


def test_passage_of_half_of_the_documents(spark, splits):
    passage = " ".join(f"running{i}" for i in range(70))
    got = suffix.dedup_substrings(table(spark, 2000, lambda rng: f" {passage} {rng.random()}")).where("n_removed > 600")
    assert got.count() == 1000 and splits() > 0
