"""Command line: ``python -m folio COMMAND``, over local files and the web."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from folio.sources import config as conf

CONFIG = "~/.config/folio/config.json"


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("folio").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def web_get(timeout: int, agent: str = "folio/1.0"):
    """A function from an address to ``(status, text)``."""

    def get(url: str) -> tuple[int, str]:
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, ""

    return get


def _image_get(url: str) -> dict:
    import urllib.request

    with urllib.request.urlopen(url) as r:
        return {"body": r.read(), "content_type": r.headers.get("Content-Type"), "disposition": r.headers.get("Content-Disposition")}


def _post(endpoint: str, key: str):
    def post(body: str) -> str:
        import urllib.request

        request = urllib.request.Request(f"{endpoint}/chat/completions", body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request) as r:
            return r.read().decode("utf-8", "replace")

    return post


def lint(args) -> int:
    from folio.operators import report
    from folio.operators.lint import explode_issues
    from folio.plans.commands import lint_documents
    from folio.sources.files import scan_globs

    if args.init:
        conf.write_lint_config(args.init_config or ".markdownlint.json")
        return 0
    docs, warnings = scan_globs(_session(), args.files)
    for w in warnings:
        print(f"warning: {w}", file=sys.stderr)
    run = lint_documents(docs, args.fix, args.enable, args.disable or (), conf.load_lint_config(args.config))
    for r in run.too_large.toLocalIterator():
        print(f"too large: {r['path']}", file=sys.stderr)
    done = run.documents.persist()
    if args.format == "json":
        rows = done.select(report.json_report(done).alias("report")).toLocalIterator()
    elif args.format == "github":
        kinds = ["path", *(["fixed_count"] if args.fix else [])]
        rows = report.annotations(explode_issues(done, *kinds)).select("report").toLocalIterator()
    else:
        rows = report.document_text(done).select("report").toLocalIterator()
    for r in rows:
        print(r["report"])
    if args.fix:  # new texts go beside the old ones, which stay
        from pyspark.sql import functions as F

        from folio.sources.files import write_texts

        changed = done.where("fixed_count > 0").select(F.concat("path", F.lit(".fixed")).alias("target"), F.col("content").alias("output"))
        for r in write_texts(changed).where("error IS NOT NULL").toLocalIterator():
            print(f"{r['path']}: {r['error']}", file=sys.stderr)
    total = run.summary.first()
    print(f"{total['files']} files, {total['issues']} issues, {total['fixed']} fixed", file=sys.stderr)
    return total["exit_code"]


def llmstxt(args) -> int:
    from folio.plans.commands import llms_txt

    spark, get = _session(), web_get(args.timeout)
    from folio.sources.compose import compose
    from folio.sources.sitemap import child_entries, fetch

    first, _ = fetch(spark.createDataFrame([(args.sitemap,)], "url string"), get)
    first = first.persist()
    from pyspark.sql import functions as F

    children, _ = fetch(first.select(F.explode(child_entries(F.col("body"))).alias("c")).select(F.col("c.loc").alias("url")), get, need_ok=False)
    report, errors = llms_txt(spark, first.unionByName(children).persist(), args.sitemap, get, args.include, args.exclude, args.max_pages, args.full, ranged=True)
    for r in errors.toLocalIterator():
        print(f"warning: {r['url']}: {r['error']}", file=sys.stderr)
    if args.output:
        compose(report, args.output)
    else:
        for r in report.toLocalIterator():
            sys.stdout.write(r["text"])
        print()
    return 0


def export(args) -> int:
    from folio.plans import commands
    from folio.sources import pandoc
    from folio.sources.compose import compose

    options = pandoc.ExportOptions(args.format, args.template, args.toc, args.toc_depth, args.shift_heading_level_by, args.file_as_title, args.site_type, args.nav_path)
    out, cwd = str(Path(args.output).resolve()), str(Path(args.dir).resolve())
    plan = commands.export(_session(), cwd, out, str(Path.cwd()), options)
    merged = Path(f"{out}.md")
    compose(plan.rows, str(merged), separator="\n\n")
    pandoc.convert([str(merged), *plan.arguments[1:]], cwd)
    return 0


def translate(args) -> int:
    from pyspark.sql import functions as F

    from folio.operators.translate import translate as run
    from folio.sources.files import scan, write_texts

    spark, (cfg, _) = _session(), conf.load(Path(CONFIG).expanduser())
    docs = scan(spark, args.source, "translate").select("path", "content")
    target = args.to or args.source
    mirror = {"target_dir": str(Path(args.to).resolve()), "source_dir": str(Path(args.source).resolve())} if args.to else {}
    there = scan(spark, target, "translate").select("path", "content") if Path(target).exists() else docs.limit(0)
    got = run(docs, there, args.locales, _post(cfg.endpoint, cfg.api_key), cfg.translate_prompt, cfg.model, args.force, args.format, **mirror, temperature=cfg.temperature, top_p=cfg.top_p).persist()
    failed = [(r["path"], r["error"]) for r in got.where("error IS NOT NULL").toLocalIterator()]
    failed += [(r["path"], r["error"]) for r in write_texts(got.where(F.col("error").isNull())).where("error IS NOT NULL").toLocalIterator()]
    for p, e in failed:
        print(f"{p}: {e}", file=sys.stderr)
    return 1 if failed else 0


def download(args) -> int:
    from pyspark.sql import functions as F

    from folio.plans.commands import download as run
    from folio.sources.files import scan, write_texts

    docs = scan(_session(), args.source, "download").select("path", "content").withColumn("doc_id", F.col("path"))
    new, files = run(docs, _image_get, args.image_dir, args.source if Path(args.source).is_dir() else None)
    for r in files.toLocalIterator():
        Path(r["file"]).parent.mkdir(parents=True, exist_ok=True)
        Path(r["file"]).write_bytes(bytes(r["body"]))
    changed = new.join(docs.select("doc_id", F.col("content").alias("old")), "doc_id").where("content <> old")
    return int(not write_texts(changed.select(F.concat("path", F.lit(".local")).alias("target"), F.col("content").alias("output"))).where("error IS NOT NULL").isEmpty())


def upload(args) -> int:
    from pyspark.sql import functions as F

    from folio.operators.publish import public_url
    from folio.plans.commands import upload as run
    from folio.sources import files, stores
    from folio.sources.cache_table import CacheTable

    spark, (cfg, _) = _session(), conf.load(Path(CONFIG).expanduser())
    s = cfg.active_storage(args.storage)
    docs = files.scan(spark, args.source, "upload").select("path", "content").withColumn("doc_id", F.col("path"))
    root, policy, prefix = args.store, args.conflict or s.conflict_policy, args.prefix or s.path_prefix
    url = lambda key: public_url(key, F.lit(s.bucket), F.lit(s.endpoint), F.lit(s.region), F.lit(s.custom_domain), F.lit(s.account_id))
    if root == "configured":
        store = stores.ArrowStore.of(s)
    else:
        store = stores.ArrowStore(root) if "://" in root else stores.LocalStore(root)
    if isinstance(store, stores.LocalStore):
        kept, table = f"{root}.cache", None
        cache = stores.read_cache(spark, kept)
    else:
        table = CacheTable(spark, Path(s.cache_dir or "~/.cache/folio", "upload-cache").expanduser().resolve().as_uri())
        cache = table.read()
    up = run(docs, files.manifest(spark, args.source), cache, lambda keys: store.listing(spark, keys), url, lambda: store, policy, prefix, args.dry_run, args.force)
    print(json.dumps(up.statistics.first().asDict()))
    if not args.dry_run:
        changed = up.documents.join(docs.select("doc_id", F.col("content").alias("old")), "doc_id").where("content <> old")
        files.write_texts(changed.select(F.concat("path", F.lit(".uploaded")).alias("target"), F.col("content").alias("output"))).collect()
        if table is None:
            stores.save_cache(up.cache, kept)
        else:
            table.put(up.fresh)
            table.compact()
    return 0


def config(args) -> int:
    path = Path(CONFIG).expanduser()
    cfg, error = conf.load(path)
    if error:
        print(error, file=sys.stderr)
    if args.action == "list":
        print(json.dumps(cfg.shown(), indent=2, ensure_ascii=False))
    elif args.action == "get":
        print(cfg.get(args.key))
    elif args.action == "set":
        conf.save(cfg.set(args.key, args.value), path)
    elif args.action == "set-default-storage":
        conf.save(cfg.with_default(args.key), path)
    else:
        for name, default in cfg.storages():
            print(f"{name}{' (default)' if default else ''}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folio")
    sub = p.add_subparsers(required=True)

    def command(f, help_: str):
        c = sub.add_parser(f.__name__, help=help_)
        c.set_defaults(run=f)
        return c

    c = command(lint, "check Markdown files")
    c.add_argument("files", nargs="*")
    for flag in ("--fix", "--init"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--format", choices=["default", "json", "github"], default="default")
    c.add_argument("--config")
    c.add_argument("--init-config")
    for flag in ("--enable", "--disable"):
        c.add_argument(flag, type=lambda v: [x.strip() for x in v.split(",") if x.strip()])
    c = command(llmstxt, "report of a site map")
    c.add_argument("sitemap")
    for flag in ("--include", "--exclude"):
        c.add_argument(flag, action="append", default=[])
    c.add_argument("--max-pages", type=int, default=0)
    c.add_argument("--timeout", type=int, default=30)
    c.add_argument("--full", action="store_true")
    c.add_argument("-o", "--output")
    c = command(export, "one document of a folder")
    c.add_argument("-d", "--dir", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--format", choices=["docx", "pdf", "epub"], default="docx")
    c.add_argument("--site-type", default="basic")
    c.add_argument("--template", default="")
    c.add_argument("--toc", action="store_true")
    c.add_argument("--toc-depth", type=int, default=3)
    c.add_argument("--shift-heading-level-by", type=int, default=0)
    c.add_argument("--file-as-title", action="store_true")
    c.add_argument("--nav-path", default="")
    c = command(translate, "translate Markdown files")
    c.add_argument("-f", "--from", dest="source", required=True)
    c.add_argument("-l", "--locales", required=True)
    c.add_argument("-t", "--to")
    c.add_argument("--force", action="store_true")
    c.add_argument("--format", action="store_true")
    c = command(download, "fetch remote images")
    c.add_argument("source")
    c.add_argument("--image-dir")
    c = command(upload, "put local images into a store")
    c.add_argument("source")
    c.add_argument("--store", required=True, help="folder of the object store, an address (s3://...), or \"configured\" for the active storage")
    c.add_argument("--storage", default="")
    c.add_argument("--prefix", default="")
    c.add_argument("--conflict", choices=["rename", "version", "overwrite"])
    for flag in ("--dry-run", "--force"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--include", help="accepted, without effect")
    c = command(config, "show or change the configuration")
    c.add_argument("action", choices=["list", "get", "set", "set-default-storage", "list-storages"])
    c.add_argument("key", nargs="?", default="")
    c.add_argument("value", nargs="?", default="")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
