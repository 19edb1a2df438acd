"""The upload cache and object stores: a local folder, and any that Arrow's file systems reach."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources import objects
from folio.sources.cache_table import CacheTable

CACHE = "local_path string, remote_path string, url string, hash string, upload_time timestamp"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``, empty if it is missing or corrupt.

    A file is one JSON document, ``{"items": {local path: {...}}, "version": "1.0"}``, which is also made where nothing is there; a folder holds JSON lines, or
    is a ``CacheTable``, as several writers and streams of uploads need it.
    """
    at = Path(path)
    if at.is_dir() or "://" in path:
        table = CacheTable(spark, path if "://" in path else at.resolve().as_uri())
        if table.deltas():
            return table.read()
        try:
            raw = spark.read.schema(CACHE).option("mode", "FAILFAST").json(path)
            raw.write.format("noop").mode("overwrite").save()
        except Exception:  # whatever is wrong with the files, uploads go on without them
            return spark.createDataFrame([], CACHE)
        return raw.where("local_path IS NOT NULL")
    if not at.exists():
        save_cache(spark.createDataFrame([], CACHE), path)
    try:
        items = json.loads(at.read_text(encoding="utf-8"))["items"]
        lines = [json.dumps({**v, "local_path": k}) for k, v in items.items()]
    except (ValueError, KeyError, TypeError, AttributeError, OSError):
        return spark.createDataFrame([], CACHE)
    text = spark.createDataFrame([(x,) for x in lines], "value string") if lines else spark.createDataFrame([], "value string")
    return text.select(F.from_json("value", CACHE).alias("c")).select("c.*").where("local_path IS NOT NULL")


def write_cache(cache: DataFrame, path: str) -> None:
    """As JSON lines, to a path other than the one it was read from."""
    cache.write.mode("overwrite").json(path)


def save_cache(cache: DataFrame, path: str) -> None:
    """As one indented JSON document, which the driver holds: the cache of a folder on one machine."""
    rows = cache.select("local_path", "remote_path", "url", "hash", F.date_format("upload_time", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("upload_time")).orderBy("local_path").toLocalIterator()
    items = {r["local_path"]: r.asDict() for r in rows}
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    tmp = at.with_name(f"{at.name}.new")
    tmp.write_text(json.dumps({"items": items, "version": "1.0"}, indent=2, ensure_ascii=False), encoding="utf-8")
    tmp.replace(at)


@dataclass
class ArrowStore:
    """Objects below ``root`` of an Arrow file system, by its address (``s3://bucket/prefix``, ``gs://``, ``hdfs://``, ``file:///``).

    Credentials, region and endpoint are those of the address's options or of the environment.  What an object says about itself is kept beside it in
    ``<key>.meta``, so that every file system can hold it; stores with metadata of their own get it too.
    """

    root: str
    etags = False  # whether tags are made of the objects' bytes

    @classmethod
    def of(cls, storage, bucket: str = "") -> ArrowStore:
        """The bucket of configured storage, by its keys, region, endpoint and prefix."""
        from urllib.parse import quote, urlencode

        scheme, _, host = storage.endpoint.rpartition("://")
        options = {k: v for k, v in (("region", "" if storage.region == "auto" else storage.region), ("scheme", scheme), ("endpoint_override", host)) if v}
        keys = f"{quote(storage.access_key, safe='')}:{quote(storage.secret_key, safe='')}@" if storage.access_key else ""
        path = "/".join(x.strip("/") for x in (bucket or storage.bucket, storage.path_prefix) if x.strip("/"))
        return cls(f"s3://{keys}{path}" + (f"?{urlencode(options)}" if options else ""))

    @property
    def uri(self) -> str:
        return self.root

    def _at(self, key: str):
        store, root = objects.open_store(self.uri)
        return store, f"{root}/{key}"

    def put(self, key: str, path: str, content_type: str, metadata: dict[str, str]) -> None:
        """One object; many are written by ``objects.write_objects``."""
        own, (store, at) = {"Content-Type": content_type, **metadata}, self._at(key)
        with open(path, "rb") as f:
            objects.write_file(store, at, iter(lambda: f.read(1 << 20), b""), own)
        self.set_metadata(key, own)

    def exists(self, key: str) -> bool:
        store, at = self._at(key)
        return store.get_file_info(at).type.name == "File"

    def metadata(self, key: str) -> dict[str, str]:
        """Empty if the object is not there or says nothing."""
        return objects.read_meta(*self._at(key))

    def set_metadata(self, key: str, metadata: dict[str, str]) -> None:
        store, at = self._at(key)
        objects.write_file(store, f"{at}.meta", [json.dumps(metadata).encode()])

    def same(self, key: str, digest: str) -> bool:
        """Whether the object has the digest, by what it says; an object that is not there has none."""
        return self.exists(key) and self.metadata(key).get("Hash") == digest

    def listing(self, spark: SparkSession, wanted: DataFrame | None = None) -> DataFrame:
        """``key, hash, etag`` of all objects; with ``wanted``, hashes of those keys only. Folders are listed, and hashes read, in tasks."""
        return objects.listing(spark, self.uri, wanted, self.etags)


@dataclass
class LocalStore(ArrowStore):
    """A folder, whose objects have the digest of their bytes as tag."""

    etags = True

    @property
    def uri(self) -> str:
        return Path(self.root).resolve().as_uri()
