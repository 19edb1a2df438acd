"""Queries of sources, fetching and whole commands, and oracles that follow a document through several steps.

Fetching and model calls run against functions whose answers SQL can state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.operators import fix, fmt, images, lint, llms, merge, publish, report, translate
from folio.plans import commands
from folio.queries import _bodies, _CJK, _FM, _HEAD, _LOCAL, _SAN, _VERSION, ALL_ISSUES, FMS, LINES, MD, NL, PAGES, SQL, TAB, WS, _decided, _links_sql, _manifest, _parens_sql, md, on_md, on_pages, query
from folio.sources import files, objects, sitemap, sitemap_source
from folio.sources.cache_table import CacheTable
from folio.sources.compose import compose
from folio.sources.shared import settled, shared_dir


# -- whole fix ------------------------------------------------------------------------------------------------------------
def _lines_of(table: str, p: str) -> str:
    return f"""{p}ln AS (SELECT doc_id, unnest(string_split(content, {NL})) AS line, unnest(range(1, len(string_split(content, {NL})) + 1)) AS line_no FROM {table}),
{p}x AS (SELECT *, lag(t) OVER w AS prev, lead(t) OVER w AS nxt, lag(line) OVER w AS prev_line, lead(line) OVER w AS next_line FROM (SELECT *, trim(line, {WS}) AS t FROM {p}ln) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""


def _formatted(p: str) -> str:
    """The formatter over ``{p}x``, as ``{p}out (doc_id, formatted)``."""
    return f"""
{p}f AS (SELECT doc_id, line_no, prev, next_line, starts_with(t, '#') AS head, CASE WHEN starts_with(t, '#') THEN {_HEAD.format('line')} ELSE {_CJK.format("(SELECT " + _parens_sql("l2") + " FROM (SELECT " + _links_sql("line") + " AS l2))")} END AS line FROM {p}x),
{p}e AS (SELECT doc_id, line_no, unnest([line] || CASE WHEN head AND next_line IS NOT NULL THEN [''] ELSE []::VARCHAR[] END) AS line, unnest(range(1, 2 + CASE WHEN head AND next_line IS NOT NULL THEN 1 ELSE 0 END)) AS k FROM {p}f
      UNION ALL SELECT doc_id, line_no, '' AS line, 0 AS k FROM {p}f WHERE head AND prev <> ''),
{p}c AS (SELECT *, trim(line, {WS}) = '' AND trim(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no, k), {WS}) = '' AS gone FROM {p}e),
{p}out AS (SELECT doc_id, string_agg(line, {NL} ORDER BY line_no, k) FILTER (WHERE NOT coalesce(gone, false)) AS formatted FROM {p}c GROUP BY doc_id)"""


_T, _BEFORE = f"trim(l, {WS})", f"trim(ls[i - 1], {WS})"
_EACH = "len(list_filter(range(1, len(ls) + 1), lambda j: ls[j] <> new[j]))"
#: Per rule the new lines from ``ls`` and the count from ``ls`` and ``new``.
_STEPS = {
    "MD009": (f"list_transform(ls, lambda l: rtrim(l, ' ' || {TAB}))", _EACH),
    "MD010": (f"list_transform(ls, lambda l: replace(l, {TAB}, '    '))", _EACH),
    "MD012": (f"list_filter(ls, lambda l, i: i = 1 OR NOT ({_T} = '' AND {_BEFORE} = ''))", "len(ls) - len(new)"),
    "MD018": (rf"list_transform(ls, lambda l: CASE WHEN regexp_matches({_T}, '^#+[^# ]') THEN regexp_replace({_T}, '^(#+)([^# ])', '\1 \2') ELSE l END)", _EACH),
    "MD019": (rf"list_transform(ls, lambda l: CASE WHEN regexp_matches({_T}, '^#+\s{{2,}}') THEN regexp_replace({_T}, '^(#+)\s{{2,}}', '\1 ') ELSE l END)", _EACH),
    "MD023": ("list_transform(ls, lambda l: regexp_replace(l, '^ +#', '#'))", _EACH),
    "MD032": (rf"flatten(list_transform(ls, lambda l, i: CASE WHEN i > 1 AND regexp_matches(l, '^\s*[*+-] ') AND {_BEFORE} <> '' THEN ['', l] ELSE [l] END))", "len(new) - len(ls)"),
    "MD047": (f"ls[1:coalesce(list_max(list_filter(range(1, len(ls) + 1), lambda j: trim(ls[j], {WS}) <> '')), 0)] || ['']", "1"),
}


def _fix_all_sql() -> str:
    out = LINES + f""",
iss AS MATERIALIZED ({ALL_ISSUES}),
s0 AS (SELECT md.doc_id, content, string_split(content, {NL}) AS ls, 0 AS n, coalesce(hit, []) AS hit FROM md LEFT JOIN (SELECT doc_id, list(DISTINCT rule) AS hit FROM iss GROUP BY doc_id) USING (doc_id))"""
    for k, (rule, (new, count)) in enumerate(_STEPS.items()):
        out += f""",
s{k + 1} AS (SELECT doc_id, content, CASE WHEN list_contains(hit, '{rule}') THEN new ELSE ls END AS ls, n + CASE WHEN list_contains(hit, '{rule}') THEN {count} ELSE 0 END AS n, hit FROM (SELECT *, {new} AS new FROM s{k}))"""
    counted, fixers = ", ".join(f"'{r}'" for r in fix.COUNTED), ", ".join(f"'{r}'" for r in _STEPS)
    return out + f""",
done AS MATERIALIZED (SELECT doc_id, content AS was, array_to_string(ls, {NL}) AS content, n FROM s{len(_STEPS)}),
{_lines_of('done', 'z')},{_formatted('z')},
per AS (SELECT doc_id, count(*) AS issues, count(*) FILTER (WHERE rule IN ({counted})) AS counted, count(*) FILTER (WHERE rule IN ({fixers})) AS own, count(*) FILTER (WHERE rule IN ({fixers}) OR rule <> 'MD013') AS most FROM iss GROUP BY doc_id),
r AS (SELECT doc_id, was, formatted, coalesce(issues, 0) AS issues, coalesce(own, 0) AS own, coalesce(most, 0) AS most, CASE WHEN coalesce(issues, 0) = 0 THEN 0 WHEN n = 0 AND formatted <> content THEN counted ELSE n END::BIGINT AS fixed_count
      FROM done JOIN zout USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, CASE WHEN fixed_count > 0 THEN formatted ELSE was END AS content, fixed_count, issues, CASE WHEN fixed_count > 0 THEN most ELSE own END AS fixed FROM r"""


on_md("fix_all", _fix_all_sql(), lambda d: fix.fix(d).select("doc_id", "content", "fixed_count", F.size("issues").cast("long").alias("issues"), F.size(F.filter("issues", lambda x: x["fixed"])).cast("long").alias("fixed")))
on_md("fmt_disabled", MD + " SELECT doc_id, content AS formatted FROM md", lambda d: fmt.format_document(d, enabled=False).select("doc_id", "formatted"))
on_md(
    "lint_report_json",
    LINES + f""", i AS ({ALL_ISSUES}), o AS (SELECT doc_id, string_agg('{{"line":' || line || ',"rule":"' || rule || '","message":' || to_json(message) || CASE WHEN context <> '' THEN ',"context":' || to_json(context) ELSE '' END || '}}', ',' ORDER BY line, rule, message, context NULLS FIRST) AS js FROM i GROUP BY doc_id)
SELECT doc_id, '{{"fixed_count":0,"filename":' || to_json(path) || ',"issues":[' || coalesce(js, '') || ']}}' AS report FROM md LEFT JOIN o USING (doc_id)""",
    lambda d: lint.issues(d).transform(lambda t: t.select("doc_id", report.json_report(t).alias("report"))),
)

# -- replacements one after another ------------------------------------------------------------------------------------------
_FOLD = """,
num AS (SELECT doc_id, old, new, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM pairs),
fold AS (SELECT doc_id, 0::BIGINT AS k, content FROM md
         UNION ALL SELECT f.doc_id, num.k, CASE WHEN strpos(f.content, old) > 0 THEN f.content[:strpos(f.content, old) - 1] || new || f.content[strpos(f.content, old) + length(old):] ELSE f.content END FROM fold f JOIN num ON num.doc_id = f.doc_id AND num.k = f.k + 1)
SELECT doc_id, arg_max(content, k) AS content FROM fold GROUP BY doc_id"""
on_md(
    "upload_rewrite",
    _LOCAL.replace("WITH md", "WITH RECURSIVE md", 1) + f", res AS ({_VERSION}), pairs AS (SELECT doc_id, pos, full_match AS old, '![' || alt || '](https://cdn/' || final_path || ')' AS new FROM tasks JOIN res USING (local_path))" + _FOLD,
    lambda d: publish.rewritten(d, publish.tasks(d, _manifest(d)), _decided(d).select("local_path", F.concat(F.lit("https://cdn/"), "final_path").alias("url"))).select("doc_id", "content"),
)
_EXPORTED = r"""regexp_extract_all(content, '!\[(.*?)\]\((.*?)\)', {0})"""
on_md(
    "export_image_paths",
    MD.replace("WITH md", "WITH RECURSIVE md", 1) + f""",
er AS (SELECT doc_id, path, unnest(range(0, len(a))) AS pos, unnest(a) AS alt, unnest(u) AS url, unnest(m) AS old FROM (SELECT *, {_EXPORTED.format(1)} AS a, {_EXPORTED.format(2)} AS u, {_EXPORTED.format(0)} AS m FROM md)),
el AS (SELECT *, CASE WHEN starts_with(url, '/') THEN url WHEN starts_with(url, '../') THEN 'docs/' || url[4:] ELSE regexp_replace(path, '/[^/]*$', '') || '/' || url END AS f FROM er WHERE NOT regexp_matches(url, '^https?://')),
pairs AS (SELECT doc_id, pos, old, '![' || alt || '](' || f[6:] || ')' AS new FROM el WHERE starts_with(f, 'docs/') AND ('0x' || md5(f)[:6])::BIGINT % 10 > 0 AND NOT contains(f, '//'))""" + _FOLD,
    lambda d: images.export_paths(d, _manifest(d), "docs").select("doc_id", "content"),
)
_WEB_EXPORT = f"SELECT doc_id, path, unnest({_EXPORTED.format(2)}) AS url FROM md"
on_md("img_web_export", MD + f" SELECT doc_id, url, count(*) AS n FROM ({_WEB_EXPORT}) WHERE regexp_matches(url, '^https?://') GROUP BY ALL", lambda d: images.references(d, "doc_id", pattern=images.EXPORT_REFERENCE).where(F.col("url").rlike(r"\Ahttps?://")).groupBy("doc_id", "url").agg(F.count(F.lit(1)).alias("n")))
on_md(
    "export_file",
    MD + f", s AS (SELECT doc_id, {_FM} AS content FROM md), y AS (SELECT doc_id, unnest(string_split(content, {NL})) AS line, unnest(range(1, len(string_split(content, {NL})) + 1)) AS line_no FROM s)\nSELECT doc_id, string_agg({_SAN.format('line')}, {NL} ORDER BY line_no) AS content FROM y GROUP BY doc_id",
    lambda d: d.select("doc_id", merge.sanitise(merge.strip_front_matter(F.col("content"))).alias("content")),
)

# -- scans, site maps, fetching ------------------------------------------------------------------------------------------------
_NAMED = "'d/' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.MD' WHEN 2 THEN '.markdown' WHEN 3 THEN '.Markdown' WHEN 4 THEN '.md.txt' ELSE '/md' END"
for _kind, _test in (("lint", "(?i)\\.(md|markdown)$"), ("export", "(?i)\\.(md|markdown)$"), ("download", "\\.(md|markdown)$"), ("upload", "\\.(md|markdown)$"), ("translate", "\\.md$")):
    query(f"files_taken_{_kind}", f"SELECT doc_id, p AS path FROM (SELECT doc_id, {_NAMED.replace('AS STRING', 'AS VARCHAR')} AS p FROM documents) WHERE regexp_matches(p, '{_test}')")(
        lambda spark, sf_dir, kind=_kind: spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{_NAMED} AS path").where(files.takes(F.col("path"), kind))
    )
query("files_decoded", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '中文' || doc_id END AS content FROM documents")(
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", files.decoded(F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.concat(F.unhex(F.lit("D6D0CEC4")), F.col("doc_id").cast("string").cast("binary")))).alias("content"))
)


def _text_map(p: DataFrame) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]), "\n\n")
    return p.agg(body.alias("body")).select(F.lit("https://x/map.txt").alias("url"), "body", F.lit(200).alias("status"))


on_pages("sitemap_text", PAGES + " SELECT row_number() OVER (ORDER BY page_id) - 1 AS seq, url AS loc FROM pg", lambda p: sitemap.expand(_text_map(p), "https://x/map.txt").select("seq", "loc"))


def _answer(url: str) -> tuple[int, str]:
    if len(url) % 7 == 0:
        raise OSError("no route")
    return (404 if len(url) % 5 == 0 else 200), f"body of {url}"


on_pages("page_fetch", PAGES + " SELECT page_id, 'body of ' || url AS body, 200::BIGINT AS status FROM pg WHERE length(url) % 7 > 0 AND length(url) % 5 > 0", lambda p: sitemap.fetch(p.select("page_id", "url"), _answer)[0].select("page_id", "body", "status"))
on_pages("page_fetch_errors", PAGES + " SELECT page_id, CASE WHEN length(url) % 7 = 0 THEN 'OSError: no route' ELSE 'status 404' END AS error FROM pg WHERE length(url) % 7 = 0 OR length(url) % 5 = 0", lambda p: sitemap.fetch(p.select("page_id", "url"), _answer)[1].select("page_id", "error"))


def _read_maps(p: DataFrame, **options) -> DataFrame:
    """The index of maps of ``sitemap_urls``, written as files and read as a data source; ``map`` is the number of the url set."""
    spark, root = p.sparkSession, f"{shared_dir(p.sparkSession)}/maps-{uuid.uuid4().hex[:12]}"
    here = lambda c: F.replace(c, F.lit("https://x/s"), F.lit(f"{root}/s"))
    maps = _bodies(p).select(F.concat(F.lit(f"{root}/"), F.element_at(F.split("url", "/"), -1)).alias("target"), F.when(F.endswith("url", F.lit("index.xml")), here(F.col("body"))).otherwise(F.col("body")).alias("output"))
    settled(files.write_texts(maps))
    sitemap_source.register(spark)
    wanted = options.pop("maps", None)
    rows = spark.read.format("sitemap").options(**options).load(f"{root}/index.xml")
    if wanted is not None:
        rows = rows.where(F.col("map").isin([f"{root}/s{k}.xml" for k in wanted]))
    return rows.select("seq", "loc", "priority", F.regexp_extract("map", r"/s([0-9]+)\.xml\z", 1).cast("long").alias("map"))


_MAPS = PAGES + ", m AS (SELECT (page_id % 10) * 4294967296 + row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) - 1 AS seq, url AS loc, '0.5' AS priority, page_id % 10 AS map FROM pg) SELECT seq, loc, priority, map FROM m"
on_pages("sitemap_source", _MAPS, _read_maps)
on_pages("sitemap_source_maps", _MAPS + " WHERE map IN (2, 5)", lambda p: _read_maps(p, maps=(2, 5)))
on_pages("sitemap_source_globs", _MAPS + r" WHERE regexp_matches(loc, '^.*/(en|de)/.*$') AND NOT regexp_matches(loc, '^.*#part-.$')", lambda p: _read_maps(p, include='["**/{en,de}/**"]', exclude='["**#part-?"]'))
on_pages("sitemap_source_limit", _MAPS + " ORDER BY seq LIMIT 60", lambda p: _read_maps(p, limit=60))


def _objects(d: DataFrame) -> DataFrame:
    """Documents put as objects and listed again; hashes are read for every second one."""
    spark, uri = d.sparkSession, f"{shared_dir(d.sparkSession)}/store-{uuid.uuid4().hex[:12]}"
    key = F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = d.select("doc_id", key.alias("key"), F.encode("content", "UTF-8").alias("content"), F.create_map(F.lit("Hash"), F.md5("content")).alias("metadata"))
    errors = objects.write_objects(rows, uri)
    found = objects.listing(spark, uri, rows.where("doc_id % 2 = 0")).join(objects.listed(spark, uri), "key")
    return found.join(errors, "key", "full").select("key", "hash", "size", "error")


on_md("objects_put", MD + " SELECT 'd' || (doc_id % 7) || '/' || doc_id || '.md' AS key, CASE WHEN doc_id % 2 = 0 THEN md5(content) END AS hash, strlen(content)::BIGINT AS size, NULL::VARCHAR AS error FROM md", _objects)


def _cached(d: DataFrame) -> DataFrame:
    """The cache after uploads, later uploads of every third document and removals of every fifth, compacted in between; read by a look-up of every second path."""
    table = CacheTable(d.sparkSession, f"{shared_dir(d.sparkSession)}/cache-{uuid.uuid4().hex[:12]}")
    entry = lambda version, minute: d.select(F.col("path").alias("local_path"), F.concat(F.lit(version), F.col("doc_id").cast("string")).alias("remote_path"), F.md5("content").alias("hash"), F.lit("u").alias("url"), F.lit(f"2025-01-01 00:0{minute}:00").cast("timestamp").alias("upload_time"), "doc_id")
    table.put(entry("v2/", 2).where("doc_id % 3 = 0"))
    table.put(entry("v1/", 1))
    table.compact(every=True)
    table.remove(d.where("doc_id % 5 = 0").select(F.col("path").alias("local_path")), F.lit("2025-01-01 00:03:00").cast("timestamp"))
    table.put(entry("v4/", 4).where("doc_id % 25 = 0"))
    return table.lookup(d.where("doc_id % 2 = 0").select(F.col("path").alias("local_path"))).select("local_path", "remote_path", "hash")


on_md(
    "cache_table",
    MD + " SELECT path AS local_path, CASE WHEN doc_id % 25 = 0 THEN 'v4/' WHEN doc_id % 3 = 0 THEN 'v2/' ELSE 'v1/' END || doc_id AS remote_path, md5(content) AS hash FROM md WHERE doc_id % 2 = 0 AND (doc_id % 5 > 0 OR doc_id % 25 = 0)",
    _cached,
)


BLOCK = 1 << 20


def _file(rows: DataFrame, separator: str = "") -> DataFrame:
    """Ordered rows written as one file, of which tasks read every block again: ``block, bytes, md5``."""
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/file-{uuid.uuid4().hex[:12]}.md"
    size = compose(rows, path, separator=separator)

    def run(batches):
        import hashlib

        import pandas as pd

        store, at = objects.open_store(path)
        with store.open_input_file(at) as f:
            for pdf in batches:
                for i in pdf["id"].tolist():
                    f.seek(i * BLOCK)
                    data = f.read(BLOCK)
                    yield pd.DataFrame({"block": [i], "bytes": [len(data)], "md5": [hashlib.md5(data).hexdigest()]})

    return spark.range(-(-size // BLOCK)).mapInPandas(run, "block long, bytes long, md5 string")


def _blocks(sql: str, column: str) -> str:
    """The same of the one row of ``sql``."""
    return f"""SELECT block, octet_length(b)::BIGINT AS bytes, md5(b) AS md5 FROM (SELECT i AS block, array_slice(e, i * {BLOCK} + 1, (i + 1) * {BLOCK}) AS b
FROM (SELECT e, unnest(range(0, (octet_length(e) + {BLOCK - 1}) // {BLOCK})) AS i FROM (SELECT encode({column}) AS e FROM ({sql}))))"""


on_md("merge_file", _blocks(SQL["merge_documents"], "merged"), lambda d: _file(merge.merge_rows(d, order="path"), "\n\n"))
on_pages("llms_file", _blocks(SQL["llms_txt"], "report"), lambda p: _file(llms.render_rows(llms.page_rows(p, closed=True))))


def _image(url: str) -> dict:
    if "cdn" in url:
        raise OSError("no route")
    return {"body": url.encode(), "content_type": "image/png"}


on_md(
    "image_fetch",
    MD + r""", refs AS (SELECT doc_id, regexp_replace(path, '/[^/]*$', '') || '/images' AS dir, unnest(regexp_extract_all(content, '!\[([^\]]*)\]\(([^)]+)\)', 2)) AS url FROM md),
f AS (SELECT DISTINCT dir, url, split_part(string_split(url, '/')[-1], '?', 1) AS name FROM refs WHERE regexp_matches(url, '^https?://') AND NOT contains(url, 'cdn'))
SELECT dir || '/' || regexp_replace(name, '\.png$', '') || '_' || md5(url)[:8] || '.png' AS file, url AS body FROM f""",
    lambda d: commands.download(d, _image)[1].select("file", F.col("body").cast("string").alias("body")),
)

# -- previews and front matter -----------------------------------------------------------------------------------------------------
on_md(
    "text_preview",
    MD + f""", t AS (SELECT doc_id, trim(content, {WS}) AS t FROM md), c AS (SELECT *, list_max(list_filter(range(0, 51), lambda i: strlen(left(t, i::BIGINT)) <= 50)) AS k FROM t)
SELECT doc_id, CASE WHEN strlen(t) <= 50 THEN t ELSE left(t, k::BIGINT) || CASE WHEN strlen(left(t, k::BIGINT)) < 50 THEN chr(65533) ELSE '' END || '...' END AS preview FROM c""",
    lambda d: d.select("doc_id", tx.preview(F.col("content"), 50).alias("preview")),
)
_TAGS = "'---' || " + NL + " || 'tags:' || " + NL + " || '{0}a' || " + NL + " || '{0}b' || " + NL + " || '---' || " + NL + " || content"
on_md(
    "frontmatter_repair",
    MD + f" SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_TAGS.format('- ')} WHEN 1 THEN content ELSE {_FM} END AS body FROM md",
    lambda d: d.withColumn("content", F.expr("CASE doc_id % 3 WHEN 0 THEN " + _TAGS.format("-") + " WHEN 1 THEN " + _TAGS.format("- ") + " ELSE content END")).select("doc_id", merge.repair_front_matter(F.col("content")).alias("body")),
)

# -- translation -----------------------------------------------------------------------------------------------------------------
_MARKED = "CASE WHEN yaml IS NOT NULL THEN 'title: doc ' || doc_id || " + NL + " ELSE '' END || 'translated: true' || " + NL
on_md("translate_output", FMS + f"\nSELECT doc_id, '---' || {NL} || {_MARKED} || '---' || {NL} || {NL} || body AS output FROM f", lambda d: d.select("doc_id", translate.front_matter(F.col("content")).alias("f")).select("doc_id", translate.output(F.col("f.yaml"), F.col("f.body")).alias("output")))


def _model(request: str) -> str:
    import json

    if len(request) % 3 == 0:
        raise TimeoutError("late")
    return json.dumps({"choices": [{"message": {"role": "assistant", "content": f"<think>x</think>\nlength {len(request)}"}}] if len(request) % 3 == 1 else []})


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = md(spark, sf_dir).select("doc_id", F.repeat(F.lit("x"), (F.col("doc_id") % 50).cast("int")).alias("request"))
    got = translate.call_model(asked, _model)
    return got.select("doc_id", translate.clean_response(translate.response_text(F.col("response"))).alias("body"), "error")


query("translate_call", MD + " SELECT doc_id, CASE WHEN doc_id % 50 % 3 = 1 THEN 'length ' || (doc_id % 50) END AS body, CASE WHEN doc_id % 50 % 3 = 0 THEN 'TimeoutError: late' END AS error FROM md")(_called)
on_md(
    "translate_documents",
    FMS + f"\nSELECT path, regexp_replace(path, '(\\.[^./]*)?$', '_de\\1') AS target, '---' || {NL} || {_MARKED} || '---' || {NL} || {NL} || 'done' AS output, NULL::VARCHAR AS error FROM f",
    lambda d: translate.translate(d, d.select("path", "content").limit(0), "de", lambda request: '{"choices":[{"message":{"role":"assistant","content":"done"}}]}', "t", "m"),
)
