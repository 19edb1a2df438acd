"""Tables in the folder that the cluster shares, which cut lineage and outlive lost executors.

Tables of any columns and of no rows are kept as they are; a table that is kept twice under one name replaces the former.  They stay when a query has
ended, since its result reads them: the folder is the cluster's to clear, like that of ``checkpoint()``.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset (as in tests) a folder of this application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = Path(tempfile.mkdtemp(prefix="folio-")).as_uri()
    return _own[app]


class Scratch:
    """A folder of written tables below the shared one. ``keep`` writes and rereads, ``drop`` deletes what is done with."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)

    def give_up(self) -> None:
        """Let Spark delete the shuffle files of jobs that are done with, which it does once their plans have been collected on the driver."""
        self.spark.range(1).repartition(1).write.format("noop").mode("overwrite").save()  # the session holds on to the plan that ran last
        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand at most so many rows at once to Python in this session: whole texts are long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
