"""Delta-maintained token counts by source, language and tokenizer version.

A change is an insert, a delete or a revised count; each becomes signed rows (a revision is one of each sign), which are
additive, so a batch is summed on each task, shuffled as one row a key and task, and stored as a few rows.  Totals are the sum
over committed batches.

A batch's rows are written to a folder of their own, which also names the batches that it covers; it is then committed by one atomic step, the creation of an
empty marker file ``commits/<batch>~<folder>``.  A writer that dies before leaves a folder that nothing names; a batch that is
applied again, whole or after a crash, changes nothing; of two writers that commit one batch at the same time the marker of lesser name
counts, for all readers alike.  Compaction commits one folder that covers several batches, under a name made of these; where committed compactions
overlap, those that cover more count first and what overlaps them is left aside, so that every batch counts once whoever compacts when.

Defined cases: null source, language or tokenizer are keys of their own; a null count is 0; null or unknown operations are
refused; keys whose documents come to 0 and tokens to 0 are left out of the totals; repeated rows within a batch count each; an
empty batch commits and changes nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.mixing import word_count
from folio.llm.tokens import encoder, public_path

KEY = ["source", "lang", "tokenizer"]
COMPACTED = "compact-"
SIGNED = "source string, lang string, tokenizer string, docs long, tokens long"


def token_counts(docs: DataFrame, tokenizer: str | None = None, version: str = "word_bpe_49k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, source, lang, tokenizer, tokens`` under a tokenizer file (``words`` as its name: white-space separated words)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    if tokenizer == "words":
        return rows.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), word_count(F.col("text")).alias("tokens"))
    path = tokenizer or public_path()

    def run(batches):
        import pyarrow as pa

        encode = encoder(path).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n = [len(x) // 4 for x in encode(part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([version] * len(n)), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "tokens"])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit("insert").alias("op"), *KEY, "tokens")


def signed_rows(changes: DataFrame) -> DataFrame:
    """``op`` is ``insert`` or ``delete`` (of ``tokens`` under the key) or ``revise`` (from ``old_*`` columns, if there, to the others)."""
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).cast("long")
    new = F.struct(*KEY, F.lit(1).cast("long").alias("docs"), n("tokens").alias("tokens"))
    gone = F.struct(*KEY, F.lit(-1).cast("long").alias("docs"), (-n("tokens")).alias("tokens"))
    old_of = lambda c: F.col(f"old_{c}" if f"old_{c}" in changes.columns else c)
    old = F.struct(*[old_of(c).alias(c) for c in KEY], F.lit(-1).cast("long").alias("docs"), (-n("old_tokens") if "old_tokens" in changes.columns else F.lit(0).cast("long")).alias("tokens"))
    none = F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null"))))
    parts = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(gone)).when(F.col("op") == "revise", F.array(old, new)).otherwise(none.cast(f"array<struct<{SIGNED.replace(' ', ':').replace(',:', ',')}>>"))
    return changes.select(F.explode(parts).alias("r")).select("r.*")


class TokenRollup:
    """The rollup stored under ``uri``."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
        return path, path.getFileSystem(self._conf)

    def batches(self) -> dict[str, str]:
        """Folder of each committed batch, compactions included."""
        path, fs = self._path("commits")
        if not fs.exists(path):
            return {}
        out: dict[str, str] = {}
        for name in sorted((s.getPath().getName() for s in fs.listStatus(path)), reverse=True):
            batch, _, folder = name.partition("~")
            out[batch] = f"rows/{batch}-{folder}"  # the least name comes last
        return out

    def _covers(self, folder: str) -> list[str]:
        path, fs = self._path(f"{folder}/_covers.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, batch: str, rows: DataFrame, covers: list[str]) -> str:
        """Everything but the commit; returns the marker's name."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        own = uuid.uuid4().hex
        folder = f"rows/{batch}-{own}"
        rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.uri}/{folder}")
        path, fs = self._path(f"{folder}/_covers.json")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(covers).encode()))
        stream.close()
        return f"{batch}~{own}"

    def _commit(self, batch: str, rows: DataFrame, covers: list[str]) -> bool:
        if batch in self.batches():
            return False
        path, fs = self._path(f"commits/{self._write(batch, rows, covers)}")
        fs.create(path, False).close()
        return True

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if it had been committed before."""
        if batch.startswith(COMPACTED):
            raise ValueError(f"names that begin with {COMPACTED} are those of compactions")
        return self._commit(batch, signed_rows(changes), [batch])

    def _live(self) -> dict[str, tuple[str, list[str]]]:
        """Folder and covered batches of what counts now: each committed batch is covered once."""
        known, taken, out = self.batches(), set(), {}
        compacted = {b: self._covers(f) for b, f in known.items() if b.startswith(COMPACTED)}
        for b in sorted(compacted, key=lambda b: (-len(compacted[b]), b)):
            if not taken & set(compacted[b]):
                taken |= set(compacted[b])
                out[b] = (known[b], compacted[b])
        return out | {b: (f, [b]) for b, f in known.items() if b not in compacted and b not in taken}

    def _rows(self, live: dict[str, tuple[str, list[str]]]) -> DataFrame:
        folders = [f"{self.uri}/{folder}" for folder, _ in live.values()]
        return self.spark.read.schema(SIGNED).parquet(*folders) if folders else self.spark.createDataFrame([], SIGNED)

    def compact(self) -> None:
        """Put one folder in the place of all that count now."""
        live = self._live()
        if len(live) > 1:
            covers = sorted(b for _, own in live.values() for b in own)
            self._commit(COMPACTED + hashlib.sha256(json.dumps(covers).encode()).hexdigest()[:16], self._rows(live), covers)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens``."""
        out = self._rows(self._live()).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.where("docs <> 0 OR tokens <> 0")
