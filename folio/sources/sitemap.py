"""Site maps: url sets, indexes and plain text, from a table of fetched bodies.

A body is read as a url set if it has one url at least, else as an index if it has one child, else as lines of
text.  Children are url sets only: an index within an index is not followed, and a child that isn't one is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.sources.ledger import Ledger, lanes

FIELDS = ("loc", "lastmod", "changefreq", "priority")


def _well_formed(body: Column) -> Column:
    return F.coalesce(body.rlike(r"(?s)\A\s*(<\?xml|<!--|<urlset|<sitemapindex|<)"), F.lit(False))


def _entries(body: Column, root: str, item: str, *fields: str) -> Column:
    """Array of structs, in order; an entry without a field has an empty one.

    Entries are cut out first and each is read by itself, so that a missing field does not shift those of later entries.
    """
    part = F.regexp_extract_all(body, F.lit(rf"(?s)<(?:\w+:)?{item}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{item}>"), F.lit(1))
    inside = body.rlike(rf"(?s)<(?:\w+:)?{root}[\s>]")
    text = lambda p, f: _unescape(F.regexp_extract(p, rf"(?s)<(?:\w+:)?{f}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</(?:\w+:)?{f}>", 1))
    made = F.transform(part, lambda p: F.struct(*[text(p, f).alias(f) for f in fields]))
    return F.when(_well_formed(body) & inside, made).otherwise(F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"))


def _unescape(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def url_entries(body: Column) -> Column:
    return _entries(body, "urlset", "url", *FIELDS)


def child_entries(body: Column) -> Column:
    return _entries(body, "sitemapindex", "sitemap", "loc", "lastmod")


def kind(body: Column) -> Column:
    """``urlset``, ``index`` or ``text``. An empty url set is text, whose lines then count as addresses."""
    return F.when(F.size(url_entries(body)) > 0, "urlset").when(F.size(child_entries(body)) > 0, "index").otherwise("text")


def text_urls(body: Column) -> Column:
    """Lines that are not empty, as they are."""
    return F.filter(F.split(body, "\n", -1), lambda s: s != "")


def expand(bodies: DataFrame, start: str) -> DataFrame:
    """``seq, loc, lastmod, changefreq, priority`` of the map at ``start``, in order, repeats and all, empty addresses left out.

    ``bodies`` is ``url, body, status``; the first must have status 200, children need only be there.
    """
    top = bodies.where((F.col("url") == start) & (F.coalesce("status", F.lit(200)) == 200)).withColumn("kind", kind(F.col("body")))
    plain = F.transform(text_urls(F.col("body")), lambda u: F.struct(u.alias("loc"), *[F.lit("").alias(f) for f in FIELDS[1:]]))
    direct = top.where("kind <> 'index'").select(F.lit(0).alias("child"), F.posexplode(F.when(F.col("kind") == "urlset", url_entries(F.col("body"))).otherwise(plain)).alias("pos", "u"))
    children = top.where("kind = 'index'").select(F.posexplode(child_entries(F.col("body"))).alias("child", "c"))
    below = children.join(bodies.select(F.col("url").alias("child_url"), F.col("body").alias("child_body")), F.col("c.loc") == F.col("child_url"))
    below = below.select("child", F.posexplode(url_entries(F.col("child_body"))).alias("pos", "u"))
    rows = direct.unionByName(below).where("u.loc <> ''")
    # the order key is child and position: unique, and ordered as the union is
    return rows.select((F.col("child").cast("long") * F.lit(1 << 32) + F.col("pos")).alias("seq"), "u.*")


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str]], need_ok: bool = True, url: str = "url", per_host: int = 5, seconds: float = 30.0, deadline: float | None = None, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``urls`` with ``status, body`` of what could be had, and with ``error`` of the rest.

    ``get`` runs on the executors, once for each address, however often the two tables are read and whatever tasks fail; at most ``per_host`` addresses of a host are
    asked at once, each for so many seconds.  With ``ledger``, a folder, what was had before is not asked again.  Columns of these names give way to the new ones.
    """

    def one(u: str) -> dict:
        status, body = get(u)
        return {"status": status, "body": body}

    own = urls.drop("status", "body", "error", "result")
    got = Ledger(urls.sparkSession, "status long, body string", ledger).settle(own, one, url, lane=lanes(F.col(url), per_host), seconds=seconds, deadline=deadline)
    bad = F.coalesce("error", F.when(F.lit(need_ok) & F.coalesce(F.col("result.status") != 200, F.lit(True)), F.concat(F.lit("status "), F.coalesce(F.col("result.status").cast("string"), F.lit("unknown")))))
    rows = got.withColumn("error", bad)
    return rows.where("error IS NULL").select(*own.columns, "result.body", "result.status"), rows.where("error IS NOT NULL").select(*own.columns, "error", "result.status")
