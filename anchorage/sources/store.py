"""A folder that the whole cluster shares, for files that are written and read again within a session."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds between two clearings of shuffle files that nothing refers to any more.
TIDY = 2.0
#: Tables of up to so many bytes are sent to every task where that saves a shuffle of the other side.
BROADCAST_BYTES = 64 << 20
_tidied = [time.monotonic()]


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below the warehouse, or on one machine in a temporary place. It goes when the session ends."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        root = root.rstrip("/")
    elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        held = tempfile.TemporaryDirectory(prefix="anchorage-")
        atexit.register(held.cleanup)
        root = f"file://{held.name}"
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{root}/files-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, root: str, name: str) -> DataFrame:
    """df, written to a folder() and read again: its lineage is cut, a lost executor costs its running tasks, and a join with it can be split for skew."""
    spark, schema = df.sparkSession, df.schema
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    del df
    if time.monotonic() - _tidied[0] > TIDY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _tidied[0] = time.monotonic()
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of a table take no more than so many bytes, so that a task may hold them. Counts the characters of strings and 24 bytes for each other column and row."""
    size = F.lit(24)
    for f in df.schema.fields:
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() == "string" else 0) + 24
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def dropped(spark: SparkSession, root: str, *names: str) -> None:
    """Deletes tables that written() made. No later plan may read them."""
    for name in names:
        _remove(spark, f"{root}/{name}")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
