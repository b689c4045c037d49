"""Intermediate tables in the folder that the whole cluster shares.

An operator with several passes writes what it needs again as Parquet and reads it back: this cuts the lineage, the
pass is computed once, and a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two clearings; passes that take less leave little to clear.
TIDY = 2.0
_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, the warehouse, or on one machine a temporary one."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        held = tempfile.TemporaryDirectory(prefix="anchorage-")
        atexit.register(held.cleanup)
        _LOCAL_ROOTS[app] = f"file://{held.name}"
    return _LOCAL_ROOTS[app]


class Scratch:
    """Tables of one run of an operator. What the returned DataFrame still reads stays until the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        self.tidied = time.monotonic()
        atexit.register(self._end)

    def put(self, df: DataFrame) -> DataFrame:
        """df, written and read again; shuffle files that only its making needed can go."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        del df
        self.tidy()
        return out

    def tidy(self) -> None:
        """Lets the context cleaner remove the shuffle files of plans that nothing refers to any more, some seconds' worth at a time."""
        if time.monotonic() - self.tidied > TIDY:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            self.tidied = time.monotonic()

    def drop(self, df: DataFrame) -> None:
        """Deletes what put() wrote for df. No later plan may read it."""
        self._delete(df.scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _end(self) -> None:
        with contextlib.suppress(Exception):
            self._delete(self.root)
