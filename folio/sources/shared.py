"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset (as in tests), a folder of this application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = Path(tempfile.mkdtemp(prefix="folio-")).as_uri()
        root = _own[app]
    return root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand at most so many rows at once to Python in this session: a batch of whole pages or documents is held on both sides, with what is made of it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
