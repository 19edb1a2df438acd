"""Continuous linting and an upload cache kept by micro-batches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from folio.operators import lint


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, content string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def lint_stream(docs: DataFrame, rules: Iterable[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Issue rows of a stream of documents: no state, no watermark."""
    return lint.lint(docs, rules, key)


def append_issues(docs: DataFrame, to: str, checkpoint: str, rules: Iterable[str] | None = None) -> StreamingQuery:
    return lint_stream(docs, rules).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def keep_cache(uploads: DataFrame, path: str, checkpoint: str, compact_every: int = 16) -> StreamingQuery:
    """Put streamed uploads into the cache table at ``path``: a delta for each micro-batch, named after it, so a batch that is run again changes nothing.

    What a batch writes follows the batch; small deltas are put together every so many batches.
    """
    from folio.sources.cache_table import CacheTable

    def step(batch: DataFrame, epoch: int) -> None:
        table = CacheTable(batch.sparkSession, path)
        table.put(batch, f"batch-{epoch:012d}")
        if epoch % compact_every == compact_every - 1:
            table.compact()

    return uploads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
