"""The commands of the toolkit as plans: each returns DataFrames and leaves inputs as they are."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import fix as fixers
from folio.operators import images, lint, llms, merge, publish, report
from folio.sources import files, nav, pandoc, sitemap
from folio.sources.ledger import Ledger, lanes
from folio.sources.shared import settled


@dataclass
class LintRun:
    documents: DataFrame
    too_large: DataFrame
    summary: DataFrame


def lint_documents(docs: DataFrame, autofix: bool = False, enabled: Iterable[str] | None = None, disabled: Iterable[str] = (), config: dict[str, bool] | None = None) -> LintRun:
    """Issues (and with ``autofix`` new contents, the old ones kept beside) of ``path, content`` rows."""
    rules = lint.select_rules(enabled, disabled, config)
    fit, large = lint.size_guard(docs)
    done = fixers.fix(fit, rules) if autofix else lint.issues(fit, rules)
    return LintRun(done, large.select("path"), report.summary(done, autofix))


def llms_txt(spark: SparkSession, bodies: DataFrame, start: str, get: Callable[[str], tuple[int, str]], include=(), exclude=(), max_pages: int = 0, full: bool = False, ranged: bool = False) -> tuple[DataFrame, DataFrame]:
    """The report of a site map, and the pages that could not be had. Filter and limit come before any fetch.

    With ``ranged`` the report comes as ordered rows (``text``), for ``compose``.
    """
    from folio.operators.urls import filter_urls, limit_urls

    urls = sitemap.expand(bodies, start).select("seq", F.col("loc").alias("url"))
    chosen = limit_urls(filter_urls(urls, include, exclude), max_pages)
    pages, errors = sitemap.fetch(chosen, get)
    rows = llms.page_rows(pages.withColumnRenamed("body", "html"), full, "seq")
    return (llms.render_rows(rows) if ranged else llms.render(rows)), errors


@dataclass
class Export:
    merged: DataFrame
    arguments: list[str]
    rows: DataFrame  # ``text`` in order, two line feeds between: the same for ``compose``


def export(spark: SparkSession, root: str, output: str, cwd: str, options: pandoc.ExportOptions | None = None) -> Export:
    """One document of a folder's Markdown files, in order of path or of the site's navigation, and the converter's arguments.

    A single file is neither merged nor shifted; of several, levels are shifted here and by the converter too.
    """
    options = options or pandoc.ExportOptions()
    docs = files.scan(spark, root, "export")
    docs = files.ordered(docs) if options.site_type == "basic" else nav.in_order(docs, nav.site_files(spark, options.site_type, root, options.nav_path))
    n = docs.limit(2).count()
    if n == 0:
        raise FileNotFoundError(f"no Markdown files in {root}")
    docs = docs.withColumn("doc_id", F.col("path"))
    if n == 1:
        one = docs.select(merge.sanitise(merge.strip_front_matter(F.col("content"))).alias("merged"))
        return Export(one, pandoc.arguments(f"{cwd}/merged.md", output, cwd, options), one.select(F.col("merged").alias("text")))
    placed = images.export_paths(docs, files.manifest(spark, root), cwd)
    dirs = [r["dir"] for r in merge.source_dirs(placed).orderBy("first_ord").toLocalIterator()]
    merged = merge.merge(placed, options.shift, options.file_as_title, sanitised=2)
    return Export(merged, pandoc.arguments(f"{cwd}/merged.md", output, cwd, options, dirs), merge.merge_rows(placed, options.shift, options.file_as_title, sanitised=2))


def download(docs: DataFrame, get: Callable[[str], dict], explicit_dir: str | None = None, source_dir: str | None = None, key: str = "doc_id", per_host: int = 5, seconds: float = 30.0, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with remote images rewritten to local files, and ``file, body`` of the images.

    ``get`` runs on the executors, once for each address, and returns ``{"body": bytes, "content_type": ..., "disposition": ...}``; the status does not matter, and the link of
    an image that cannot be had stays as it is.
    """
    refs = images.references(docs, key, "path").withColumn("remote", images.remote_url(F.col("url"))).where(F.col("remote").isNotNull())
    folder = images.image_dir(F.col("path"), explicit_dir, source_dir)

    def one(u: str) -> dict:
        r = get(u)
        return {c: r.get(c) for c in ("body", "content_type", "disposition")}

    effects = Ledger(docs.sparkSession, "body binary, content_type string, disposition string", ledger)
    fetched = effects.settle(refs.select("remote").distinct(), one, "remote", lane=lanes(F.col("remote"), per_host), seconds=seconds).where("error IS NULL").select("remote", "result.*")
    name = images.unique_name(images.file_name(F.col("remote"), F.col("disposition")), F.col("remote"), F.col("content_type"))
    placed = refs.withColumn("dir", folder).join(fetched.select("remote", "body", name.alias("name")), "remote").withColumn("file", F.concat("dir", F.lit("/"), "name"))
    from folio.functions.text import file_dir

    link = F.concat(F.lit("!["), F.col("alt"), F.lit("]("), images.relative_path(F.col("file"), file_dir(F.col("path"))), F.lit(")"))
    new = images.rewrite(docs, placed.select(key, "pos", F.col("full_match").alias("old"), link.alias("new")), key)
    return new, placed.select("file", "body").dropDuplicates(["file"])


@dataclass
class Upload:
    documents: DataFrame
    results: DataFrame
    cache: DataFrame
    statistics: DataFrame
    missing: DataFrame
    fresh: DataFrame


def upload(docs: DataFrame, manifest: DataFrame, cache: DataFrame, listing: DataFrame | Callable[[DataFrame], DataFrame], url_of: Callable[[Column], Column], store: Callable[[], publish.ObjectStore], policy: str = "rename", prefix: str = "", dry_run: bool = False, force: bool = False, clock: Column | None = None, key: str = "doc_id") -> Upload:
    """Local images put in a store and links rewritten. A cached path is not looked at again unless forced; failures leave links.

    ``listing`` is what the store holds, or a function that lists it for wanted keys (``key``), whose hashes alone are needed.
    """
    todo = publish.tasks(docs, manifest, key)
    hits, misses = publish.split_by_cache(todo, cache, force)
    held = listing(misses.select(F.col("remote_path").alias("key"))) if callable(listing) else listing
    decided = settled(publish.resolve(misses, held, policy, clock, dry_run, force))  # decided once: the clock moves on, and the store changes by what follows
    results = settled(publish.put_objects(decided, store, prefix).withColumn("url", url_of(F.col("final_path"))))
    good = results.where("error IS NULL")
    links = good.where("action <> 'dry_run'").select("local_path", "url").unionByName(hits.select("local_path", F.col("cached_url").alias("url")).distinct())
    documents = publish.rewritten(docs, todo, links, key)
    fresh = good.where("action = 'upload'").select("local_path", "remote_path", "url", F.col("md5").alias("hash"), F.current_timestamp().alias("upload_time"))
    passes = hits.select(key).distinct().unionByName(misses.join(good.where("action <> 'dry_run'"), "local_path").select(key).distinct())
    return Upload(documents, results, publish.merge_cache(cache, fresh), publish.statistics(docs, hits, results, passes), publish.missing(docs, manifest, key), fresh)


def output_path(directory: str, name: str) -> str:
    return posixpath.join(directory, name)
