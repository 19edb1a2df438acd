"""Publishing images to an object store: a plan of decisions as joins, a sink behind a small protocol, and the rewritten documents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import extension
from folio.operators.images import content_type, is_local, local_path, references, remote_key, rewrite
from folio.sources.objects import write_objects

POLICIES = ("rename", "version", "overwrite")
#: Providers share one implementation of the object protocol.
PROVIDERS = ("minio", "r2", "s3")


class ObjectStore(Protocol):
    """A place for objects, by its address."""

    @property
    def uri(self) -> str: ...


def account_id(endpoint: Column) -> Column:
    """First label of the host of an endpoint."""
    return F.substring_index(F.regexp_replace(endpoint, r"\Ahttps?://", ""), ".", 1)


def public_url(key: Column, bucket: Column, endpoint: Column, region: Column, custom_domain: Column, account: Column) -> Column:
    """Custom domain, then the public development host of an account, then the endpoint, then the regional host. Empty means unset."""
    end = F.rtrim(F.coalesce(endpoint, F.lit("")), F.lit("/"))
    own = F.coalesce(F.when(account != "", account), account_id(F.coalesce(endpoint, F.lit(""))))
    slash = F.lit("/")
    return (
        F.when(custom_domain != "", F.concat(F.lit("https://"), custom_domain, slash, key))
        .when(F.contains(F.coalesce(endpoint, F.lit("")), F.lit("r2.dev")) & (own != ""), F.concat(F.lit("https://pub-"), bucket, F.lit("."), own, F.lit(".r2.dev/"), key))
        .when(end.rlike(r"\Ahttps?://"), F.concat(end, slash, bucket, slash, key))
        .when(end != "", F.concat(F.lit("https://"), end, slash, bucket, slash, key))
        .otherwise(F.concat(F.lit("https://"), bucket, F.lit(".s3."), region, F.lit(".amazonaws.com/"), key))
    )


def with_prefix(key: Column, prefix: str) -> Column:
    if not prefix:
        return key
    p = prefix.rstrip("/") + "/"
    return F.when(F.startswith(key, F.lit(p)), key).otherwise(F.concat(F.lit(p), key))


def same_object(listing_hash: Column, etag: Column, digest: Column) -> Column:
    """Whether an object has the digest: by its metadata, else by its tag without quotes."""
    return F.coalesce(F.coalesce(listing_hash, F.trim(etag, F.lit('"'))) == digest, F.lit(False))


def tasks(docs: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, pos, alt, full_match, local_path, md5, remote_path`` of local references whose file is in ``manifest`` (``path, md5``)."""
    refs = references(docs, key, "path").where(is_local(F.col("url"))).withColumn("local_path", local_path(F.col("url"), F.col("path")))
    found = refs.join(manifest.select(F.col("path").alias("local_path"), "md5"), "local_path")
    return found.select(key, "pos", "alt", "full_match", "local_path", "md5", remote_key(F.col("local_path"), F.col("md5")).alias("remote_path"))


def missing(docs: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    refs = references(docs, key, "path").where(is_local(F.col("url"))).withColumn("local_path", local_path(F.col("url"), F.col("path")))
    return refs.join(manifest.select(F.col("path").alias("local_path")), "local_path", "left_anti").select(key, "pos", "local_path")


def split_by_cache(todo: DataFrame, cache: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tasks that the cache answers (by path alone, with its address) and the others; forced, none are answered."""
    known = cache.select("local_path", F.col("url").alias("cached_url"))
    if force:
        return todo.withColumn("cached_url", F.lit(None).cast("string")).where("false"), todo
    return todo.join(known, "local_path"), todo.join(known, "local_path", "left_anti")


def cached_by_hash(todo: DataFrame, cache: DataFrame) -> DataFrame:
    """Tasks whose digest the cache knows under any path."""
    return todo.join(cache.select(F.col("hash").alias("md5")).distinct(), "md5", "left_semi")


def resolve(todo: DataFrame, listing: DataFrame, policy: str, clock: Column | None = None, dry_run: bool = False, force: bool = False) -> DataFrame:
    """One row for each path: ``local_path, md5, remote_path, final_path, action`` with ``reuse``, ``upload`` or ``dry_run``.

    ``listing`` is ``key, hash, etag`` of existing objects.  An object of the same digest is reused (unless forced); else a taken key is
    renamed by ``clock``, given the least free version, or overwritten.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown conflict policy: {policy}")
    one = todo.groupBy("local_path").agg(F.min("md5").alias("md5"), F.min("remote_path").alias("remote_path"))
    if dry_run:
        return one.withColumn("final_path", F.col("remote_path")).withColumn("action", F.lit("dry_run"))
    taken = listing.select(F.col("key").alias("remote_path"), F.lit(True).alias("taken"), "hash", "etag")
    held = one.join(taken, "remote_path", "left")
    reuse = F.col("taken").isNotNull() & same_object(F.col("hash"), F.col("etag"), F.col("md5"))
    if force:
        reuse = F.lit(False)
    ext = extension(F.col("remote_path"))
    base = F.substring("remote_path", F.lit(1), F.char_length("remote_path") - F.char_length(ext))
    clash = F.col("taken").isNotNull() & ~reuse
    if policy == "rename":
        final = F.when(clash, F.concat(base, F.lit("_"), (clock if clock is not None else F.unix_micros(F.current_timestamp()) * 1000).cast("string"), ext)).otherwise(F.col("remote_path"))
    elif policy == "overwrite":
        final = F.col("remote_path")
    else:
        free = least_free_versions(held.where(clash).select("remote_path").distinct(), listing)
        held = held.join(free, "remote_path", "left")
        final = F.when(clash, F.col("free_path")).otherwise(F.col("remote_path"))
    return held.select("local_path", "md5", "remote_path", final.alias("final_path"), F.when(reuse, "reuse").otherwise("upload").alias("action"))


def least_free_versions(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """``remote_path, free_path``: ``base_v<n>.ext`` for the least n from 1 that the listing lacks.

    Versions that exist are numbered in order; the first whose number exceeds its rank leaves a gap, which is the answer.
    """
    ext = extension(F.col("remote_path"))
    base = F.substring("remote_path", F.lit(1), F.char_length("remote_path") - F.char_length(ext))
    wanted = keys.select("remote_path", base.alias("base"), ext.alias("ext"))
    versioned = listing.select(F.regexp_extract("key", r"(?s)\A(.*)_v([1-9][0-9]{0,8})(\.[^./]*)?\z", 1).alias("base"), F.regexp_extract("key", r"(?s)\A(.*)_v([1-9][0-9]{0,8})(\.[^./]*)?\z", 2).alias("v"), extension(F.col("key")).alias("ext")).where("v <> ''").distinct()
    have = wanted.join(versioned, ["base", "ext"]).withColumn("v", F.col("v").cast("long"))
    rank = F.row_number().over(Window.partitionBy("remote_path").orderBy("v"))
    run = have.withColumn("rank", rank).where("v = rank").groupBy("remote_path").agg(F.max("v").alias("v"))
    return wanted.join(run, "remote_path", "left").select("remote_path", F.concat("base", F.lit("_v"), (F.coalesce("v", F.lit(0)) + 1).cast("string"), "ext").alias("free_path"))


def put_objects(decided: DataFrame, store: Callable[[], ObjectStore], prefix: str = "") -> DataFrame:
    """Upload what is decided so; ``decided`` with ``key`` and ``error`` (null if it went well). Objects and what they say about themselves appear together, by a commit."""
    keyed = decided.drop("key", "content_type", "error").withColumn("key", with_prefix(F.col("final_path"), prefix)).withColumn("content_type", content_type(F.col("local_path")))
    metadata = F.create_map(F.lit("Content-Type"), F.col("content_type"), F.lit("Hash"), F.col("md5"))
    done = write_objects(keyed.where("action = 'upload'").select("key", F.col("local_path").alias("path"), metadata.alias("metadata")), store().uri)
    return keyed.join(done, "key", "left").select(*keyed.columns, F.when(F.col("action") == "upload", F.col("error")).alias("error"))


def rewritten(docs: DataFrame, todo: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the links of each result (``local_path, url``) replaced; links without a result stay."""
    new = todo.join(results.select("local_path", "url"), "local_path")
    link = F.concat(F.lit("!["), F.col("alt"), F.lit("]("), F.col("url"), F.lit(")"))
    return rewrite(docs, new.select(key, "pos", F.col("full_match").alias("old"), link.alias("new")), key)


def merge_cache(cache: DataFrame, uploaded: DataFrame) -> DataFrame:
    """The cache with uploads put in: of a path the upload counts, and of several the latest."""
    both = cache.select("local_path", "remote_path", "url", "hash", "upload_time", F.lit(0).alias("_new")).unionByName(uploaded.select("local_path", "remote_path", "url", "hash", "upload_time", F.lit(1).alias("_new")))
    last = both.groupBy("local_path").agg(F.max(F.struct("_new", "upload_time", "remote_path", "url", "hash")).alias("x"))
    return last.select("local_path", "x.remote_path", "x.url", "x.hash", "x.upload_time")


def remove_from_cache(cache: DataFrame, paths: DataFrame) -> DataFrame:
    return cache.join(paths.select("local_path"), "local_path", "left_anti")


def statistics(docs: DataFrame, hits: DataFrame, results: DataFrame, changed: DataFrame) -> DataFrame:
    """One row of counters: ``total, processed, uploaded, skipped, failed, changed``.

    ``results`` has ``action, error``; ``changed`` names documents once for each pass that rewrote them.
    """
    failed = F.col("error").isNotNull()
    r = results.agg(F.count_if((F.col("action") == "upload") & ~failed).alias("uploaded"), F.count_if((F.col("action") != "upload") & ~failed).alias("reused"), F.count_if(failed).alias("failed"))
    counts = docs.agg(F.count(F.lit(1)).alias("total")).crossJoin(hits.agg(F.count(F.lit(1)).alias("hits"))).crossJoin(r).crossJoin(changed.agg(F.count(F.lit(1)).alias("changed")))  # one row each
    return counts.select("total", F.col("total").alias("processed"), "uploaded", (F.col("hits") + F.col("reused")).alias("skipped"), "failed", "changed")
