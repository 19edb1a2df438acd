"""Objects of a store: listed by folders in tasks, and written as a whole or not at all.

**Writing** is a data source (``format("objects")``).  A task stages its objects below ``_staging/<job>/<attempt>`` and names them in a manifest; the commit, on the driver, writes down
which attempts count, and nothing else.  Then tasks publish what those manifests name: an object is moved to its key, and only after it what it says about itself, ``<key>.meta``.
Both steps can run again: a task that dies while it stages leaves an attempt that no one names, one that dies while it publishes is continued where it was.  ``recover`` finishes
jobs whose driver died after the commit.  An aborted job removes what it staged.

**Listing** goes down folder by folder, the folders of a level dealt to tasks; the driver sees whether there is another level, and no key.  What objects say about themselves is
read for wanted keys only.  Manifests are written and read line by line and folders of a local or mounted file system entry by entry, so a task holds no more than
a batch of either (of other stores Arrow hands over a folder as a whole).

Defined cases: rows with a null key, or one that leaves the store (``..``), and rows whose file cannot be read have an error and write nothing; of rows with one key the one with the least path counts; null
content is an empty object; an empty table writes nothing; an empty or missing store lists nothing; files named ``*.meta`` and ``_staging`` are not objects.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from folio.sources.shared import settled, small_batches

STAGING, MANIFEST, COMMITTED = "_staging", "manifest.json", "committed.json"
SCHEMA = "key string, path string, content binary, metadata map<string,string>"
#: Rows handed over at once in a listing.
ROWS = 10_000


def open_store(uri: str):
    """The file system and the folder of an address."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(re.sub(r"\As3[an]://", "s3://", uri))
    return store, root.rstrip("/")


def write_file(store, at: str, chunks, metadata: dict[str, str] | None = None) -> None:
    """A file by a rename, so that it is whole or absent."""
    store.create_dir(at.rpartition("/")[0], recursive=True)
    tmp = f"{at}.{uuid.uuid4().hex}.part"
    try:
        out = store.open_output_stream(tmp, metadata=metadata or {})
    except NotImplementedError:  # a file system without metadata
        out = store.open_output_stream(tmp)
    with out:
        for c in chunks:
            out.write(c)
    store.move(tmp, at)


def read_file(store, at: str) -> bytes:
    with store.open_input_stream(at) as f:
        return f.read()


def read_meta(store, at: str) -> dict[str, str]:
    """What the object says about itself; empty if it is not there or says nothing."""
    try:
        return json.loads(read_file(store, f"{at}.meta").decode())
    except FileNotFoundError:
        return {}


@dataclass
class Staged(WriterCommitMessage):
    attempt: str


class ObjectWriter(DataSourceWriter):
    def __init__(self, options):
        self.uri, self.job = options["path"], options["job"]

    def _stage(self, store, at: str, row) -> None:
        if not row["key"] or ".." in row["key"].split("/"):
            raise ValueError(f"no key of this store: {row['key']}")
        if row["path"] is None:
            write_file(store, at, [bytes(row["content"] or b"")], row["metadata"])
        else:
            with open(row["path"], "rb") as f:
                write_file(store, at, iter(lambda: f.read(1 << 20), b""), row["metadata"])

    def write(self, rows) -> Staged:
        from pyspark import TaskContext

        store, root = open_store(self.uri)
        task = TaskContext.get()
        attempt = f"{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex}"
        folder = f"{root}/{STAGING}/{self.job}/{attempt}"

        def lines() -> Iterator[bytes]:
            for n, row in enumerate(rows):
                line = {"key": row["key"], "staged": f"{n:08d}", "metadata": row["metadata"] or {}, "error": None}
                try:
                    self._stage(store, f"{folder}/{n:08d}", row)
                except Exception as e:  # one object's failure is its row
                    line["error"] = f"{type(e).__name__}: {e}"
                yield json.dumps(line).encode() + b"\n"

        write_file(store, f"{folder}/{MANIFEST}", lines())
        return Staged(attempt)

    def commit(self, messages: list[Staged]) -> None:
        store, root = open_store(self.uri)
        write_file(store, f"{root}/{STAGING}/{self.job}/{COMMITTED}", [json.dumps(sorted(m.attempt for m in messages if m is not None)).encode()])

    def abort(self, messages) -> None:
        _drop(self.uri, self.job)


class ObjectSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options)


def _drop(uri: str, job: str) -> None:
    store, root = open_store(uri)
    if store.get_file_info(f"{root}/{STAGING}/{job}").type.name == "Directory":
        store.delete_dir(f"{root}/{STAGING}/{job}")


def _manifest(store, at: str) -> Iterator[dict]:
    with store.open_input_stream(at) as f:
        for line in io.TextIOWrapper(io.BufferedReader(f, 1 << 16), "utf-8"):
            yield json.loads(line)


def publish_attempt(uri: str, job: str, attempt: str) -> Iterator[tuple[str, str | None]]:
    """Move an attempt's objects to their keys, each before its metadata; those that are there already stay."""
    store, root = open_store(uri)
    folder = f"{root}/{STAGING}/{job}/{attempt}"
    for line in _manifest(store, f"{folder}/{MANIFEST}"):
        if line["error"] is None:
            staged, at = f"{folder}/{line['staged']}", f"{root}/{line['key']}"
            if store.get_file_info(staged).type.name == "File":
                store.create_dir(at.rpartition("/")[0], recursive=True)
                store.move(staged, at)
            write_file(store, f"{at}.meta", [json.dumps(line["metadata"]).encode()])
        yield line["key"], line["error"]


def publish(spark: SparkSession, uri: str, job: str) -> DataFrame:
    """``key, error`` of what a committed job wrote, which is published now."""
    store, root = open_store(uri)
    attempts = json.loads(read_file(store, f"{root}/{STAGING}/{job}/{COMMITTED}").decode())  # a name for each task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for attempt in pdf["attempt"]:
                for some in batched(publish_attempt(uri, job, attempt), ROWS):
                    yield pd.DataFrame(some, columns=["key", "error"], dtype=object)

    rows = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(max(1, len(attempts)), "attempt").mapInPandas(run, "key string, error string")
    done = settled(rows)
    _drop(uri, job)
    return done


def write_objects(objects: DataFrame, uri: str) -> DataFrame:
    """Write rows of ``key`` with a ``path`` (a file that executors reach) or ``content``, and ``metadata``; ``key, error`` when all are published."""
    spark, job = objects.sparkSession, uuid.uuid4().hex[:12]
    there = {c: F.col(c) if c in objects.columns else F.lit(None) for c in ("path", "content", "metadata")}
    rows = objects.select("key", there["path"].cast("string").alias("path"), there["content"].cast("binary").alias("content"), there["metadata"].cast("map<string,string>").alias("metadata"))
    first = rows.groupBy("key").agg(F.min_by(F.struct("path", "content", "metadata"), F.struct("path", F.sha2("content", 256))).alias("x")).select("key", "x.*")
    small_batches(spark)  # of whole objects
    spark.dataSource.register(ObjectSink)
    first.write.format("objects").option("path", uri).option("job", job).mode("append").save()
    return publish(spark, uri, job)


def recover(spark: SparkSession, uri: str) -> list[str]:
    """Publish the jobs that were committed and not finished, and remove the others; to be called when no job runs. The published ones."""
    from pyarrow import fs

    store, root = open_store(uri)
    done = []
    for job in store.get_file_info(fs.FileSelector(f"{root}/{STAGING}", allow_not_found=True)):
        if store.get_file_info(f"{job.path}/{COMMITTED}").type.name == "File":
            publish(spark, uri, job.base_name)
            done.append(job.base_name)
        else:
            _drop(uri, job.base_name)
    return sorted(done)


def entries(store, folder: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and size of what lies in a folder, one after another; nothing if there is none."""
    from pyarrow import fs

    if store.type_name != "local":
        for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if i.is_file or i.type.name == "Directory":
                yield i.base_name, not i.is_file, i.size or 0
        return
    try:
        found = os.scandir(folder)
    except FileNotFoundError:
        return
    with found:
        for e in found:
            try:
                if e.is_dir() or e.is_file():
                    yield e.name, e.is_dir(), e.stat().st_size
            except FileNotFoundError:  # renamed meanwhile
                continue


def listed(spark: SparkSession, uri: str) -> DataFrame:
    """``key, size`` of the objects of a store."""
    _, root = open_store(uri)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = open_store(uri)
        for pdf in batches:
            for folder in pdf["folder"]:
                found = entries(store, f"{root}/{folder}".rstrip("/"))
                kept = ((name, is_folder, size) for name, is_folder, size in found if (is_folder and (folder or name != STAGING)) or (not is_folder and not name.endswith((".meta", ".part"))))
                for some in batched(kept, ROWS):
                    yield pd.DataFrame({"name": [f"{folder}/{name}" if folder else name for name, _, _ in some], "is_folder": [x for _, x, _ in some], "size": pd.array([None if is_folder else size for _, is_folder, size in some], dtype="Int64")})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, keys = spark.createDataFrame([("",)], "folder string"), None
    while True:
        found = settled(level.repartition(parts, "folder").mapInPandas(run, "name string, is_folder boolean, size long"))
        own = found.where("NOT is_folder").select(F.col("name").alias("key"), "size")
        keys = own if keys is None else keys.unionByName(own)
        level = found.where("is_folder").select(F.col("name").alias("folder"))
        if level.isEmpty():
            return keys


def described(keys: DataFrame, uri: str, etags: bool = False) -> DataFrame:
    """``key, hash, etag``: what each object says its digest is, and with ``etags`` the digest of its bytes, in quotes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        store, root = open_store(uri)

        def digest(key: str) -> str:
            md5 = hashlib.md5()
            with store.open_input_stream(f"{root}/{key}") as f:
                while chunk := f.read(1 << 20):
                    md5.update(chunk)
            return f'"{md5.hexdigest()}"'

        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "hash": [read_meta(store, f"{root}/{k}").get("Hash") for k in pdf["key"]], "etag": [digest(k) if etags else None for k in pdf["key"]]}, dtype=object)

    return keys.select("key").mapInPandas(run, "key string, hash string, etag string")


def listing(spark: SparkSession, uri: str, wanted: DataFrame | None = None, etags: bool = False) -> DataFrame:
    """``key, hash, etag`` of all objects; with ``wanted`` (``key``) only those are looked into, and the others have neither hash nor tag."""
    keys = listed(spark, uri).select("key")
    if wanted is None:
        return described(keys, uri, etags)
    wanted = wanted.select("key").distinct()
    rest = keys.join(wanted, "key", "left_anti").select("key", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("etag"))
    return described(keys.join(wanted, "key", "left_semi"), uri, etags).unionByName(rest)
