"""Linking of queries that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def stream_links(queries: DataFrame, link: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Links each micro-batch of a streaming frame of queries and appends it to Parquet, under the batch's number.

    Numbers of unlinked mentions and their clusters hold within a batch, as both need all queries they run over. A batch
    that is tried again replaces its own folder, so each is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        link(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
