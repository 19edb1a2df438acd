"""The upload cache as a table of changes, for caches and writers beyond one machine.

Every change (an upload's entries, paths to forget) is a delta: Parquet files by bucket of the path's hash, and a marker that makes it count, written when the files are there.  An entry is
the last change to its path, by time; which changes count is a set that only grows, and adding them up does not depend on their order.  So writers need not wait
for each other, none loses what another writes, and a change that is made again (under its name) changes nothing.  Compaction puts deltas of like size together into one, whose marker
names those that it stands for; two compactions at once, or one that dies, do no harm either.  An update writes what it brings, a look-up opens the buckets of its paths.

Defined cases: rows without a path are dropped; of a path's changes the one with the latest time counts, of equal times a removal, else the greatest entry; a null time is the
earliest; an empty change is a delta without rows; a missing folder is an empty cache; columns other than those of a cache are ignored.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.objects import open_store, read_file, write_file

ENTRY = ("remote_path", "url", "hash")
DELTA = "local_path string, remote_path string, url string, hash string, upload_time timestamp, at timestamp, removed boolean"
BUCKETS = 64
#: A compaction takes the smaller deltas as long as the next is at most so many times what it has.
TIER = 4


class CacheTable:
    def __init__(self, spark: SparkSession, uri: str, buckets: int = BUCKETS):
        self.spark, self.uri, self.buckets = spark, uri.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("local_path"), F.lit(self.buckets)).cast("int")

    def deltas(self) -> dict[str, dict]:
        """The deltas that count, by name: their folder, number of rows and what they stand for."""
        from pyarrow import fs

        store, root = open_store(self.uri)
        found = store.get_file_info(fs.FileSelector(f"{root}/committed", allow_not_found=True))
        every = {i.base_name.removesuffix(".json"): json.loads(read_file(store, i.path).decode()) for i in found if i.path.endswith(".json")}
        gone = {name for d in every.values() for name in d["replaces"]}
        return {name: d for name, d in sorted(every.items()) if name not in gone}

    def _commit(self, rows: DataFrame, name: str, replaces: list[str]) -> None:
        folder = f"{name}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.uri}/data/delta={folder}")
        n = self._read([folder]).count()
        store, root = open_store(self.uri)
        write_file(store, f"{root}/committed/{name}.json", [json.dumps({"folder": folder, "rows": n, "replaces": replaces}).encode()])

    def _change(self, rows: DataFrame, name: str | None) -> None:
        name = name or uuid.uuid4().hex
        store, root = open_store(self.uri)
        if store.get_file_info(f"{root}/committed/{name}.json").type.name != "File":
            self._commit(rows.where("local_path IS NOT NULL"), name, [])

    def put(self, entries: DataFrame, name: str | None = None) -> None:
        """Add entries (``local_path, remote_path, url, hash, upload_time``); a change of this name that has been made is not made again."""
        own = entries.select("local_path", *ENTRY, F.col("upload_time").cast("timestamp").alias("upload_time"))
        self._change(own.withColumn("at", F.col("upload_time")).withColumn("removed", F.lit(False)), name)

    def remove(self, paths: DataFrame, at: Column | None = None, name: str | None = None) -> None:
        """Forget these paths (``local_path``) as of a time, now if none is given."""
        when = at if at is not None else F.current_timestamp()
        self._change(paths.select("local_path", *[F.lit(None).cast("string").alias(c) for c in ENTRY], F.lit(None).cast("timestamp").alias("upload_time"), when.alias("at"), F.lit(True).alias("removed")), name)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], f"{DELTA}, bucket int")
        at = f"{self.uri}/data"
        rows = self.spark.read.schema(f"{DELTA}, delta string, bucket int").option("basePath", at).parquet(*[f"{at}/delta={f}" for f in folders])
        return rows.drop("delta")

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last change to each path; rows of one path are in one bucket."""
        order = F.struct("at", "removed", "upload_time", *ENTRY)
        return rows.groupBy("bucket", "local_path").agg(F.max(order).alias("x")).select("local_path", *[f"x.{c}" for c in ENTRY], "x.upload_time", "x.at", "x.removed", "bucket")

    def _entries(self, rows: DataFrame) -> DataFrame:
        return self._last(rows).where("NOT removed").select("local_path", *ENTRY, "upload_time")

    def read(self) -> DataFrame:
        """All entries."""
        return self._entries(self._read([d["folder"] for d in self.deltas().values()]))

    def lookup(self, paths: DataFrame) -> DataFrame:
        """The entries of these paths (``local_path``); of the other buckets no file is opened."""
        wanted = paths.select("local_path").where("local_path IS NOT NULL").distinct()
        buckets = [r["b"] for r in wanted.select(self._bucket().alias("b")).distinct().collect()]  # as many as there are buckets, at most
        rows = self._read([d["folder"] for d in self.deltas().values()]).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        return self._entries(rows.join(wanted, "local_path", "left_semi"))

    def compact(self, every: bool = False) -> list[str]:
        """Put the smaller deltas together (``every``: all); the names that the new one stands for."""
        live, taken, rows = self.deltas(), [], 0
        for name, d in sorted(live.items(), key=lambda x: (x[1]["rows"], x[0])):
            if taken and not every and d["rows"] > TIER * max(rows, 1):
                break
            taken.append(name)
            rows += d["rows"]
        if len(taken) > 1:
            merged = self._last(self._read([live[n]["folder"] for n in taken])).drop("bucket")
            self._commit(merged, uuid.uuid4().hex, taken)  # removals stay, as other deltas may hold what they forget
        return taken if len(taken) > 1 else []

    def vacuum(self, seconds: float = 86_400) -> int:
        """Delete files that no delta in use has, if they are as old as that: readers and writers may still be at younger ones. The number of folders."""
        from pyarrow import fs

        store, root = open_store(self.uri)
        used, n = {d["folder"] for d in self.deltas().values()}, 0
        for i in store.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)):
            if i.base_name.removeprefix("delta=") not in used and (i.mtime is None or i.mtime.timestamp() < time.time() - seconds):
                store.delete_dir(i.path)
                n += 1
        return n
