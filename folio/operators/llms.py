"""Section-ordered reports for language models from page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import capitalise
from folio.operators.html import page_full, page_full_closed, page_head, page_head_closed
from folio.operators.urls import filter_urls, limit_urls, section, title_from_url
from folio.sources.shared import small_batches


def page_rows(pages: DataFrame, full: bool = False, seq: str = "page_id", closed: bool = False) -> DataFrame:
    """``seq, title, url, description[, content], section`` of ``seq, url, html``; with ``closed`` only character references with a semicolon count."""
    small_batches(pages.sparkSession)
    parts = (page_full_closed if full else page_head_closed) if closed else (page_full if full else page_head)
    got = pages.select(F.col(seq).alias("seq"), "url", parts(F.col("html")).alias("p"))
    title = F.when(F.col("p.title") != "", F.col("p.title")).otherwise(title_from_url(F.col("url")))
    return got.select("seq", title.alias("title"), "url", F.col("p.description").alias("description"), *([F.col("p.content").alias("content")] if full else []), section(F.col("url")).alias("section"))


def _order() -> list[Column]:
    return [F.octet_length("url").cast("long").alias("n"), F.col("seq").alias("s")]


def _listed(rows: DataFrame) -> DataFrame:
    """``section, n, s, line``: the entry of each page outside ROOT."""
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit("): "), F.col("description"), F.lit("\n"))
    if "content" in rows.columns:
        line = F.concat(line, F.when(F.col("content") != "", F.concat(F.lit("\n"), F.col("content"), F.lit("\n"))).otherwise(F.lit("")))
    return rows.where(F.col("section") != "ROOT").select("section", *_order(), F.concat(line, F.lit("\n")).alias("line"))


def _heading() -> Column:
    return F.concat(F.lit("## "), capitalise(F.col("section")), F.lit("\n\n"))


def section_texts(rows: DataFrame) -> DataFrame:
    """``section, pages, text``: each section but ROOT rendered, its pages by byte length of the address, then sequence."""
    listed = _listed(rows).groupBy("section").agg(F.array_sort(F.collect_list(F.struct("n", "s", "line"))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "")
    return listed.select("section", F.size("ls").cast("long").alias("pages"), F.concat(_heading(), body).alias("text"))


def root_head(rows: DataFrame) -> DataFrame:
    """One row ``head``: title and description of the first ROOT page, empty ones if there is none."""
    first = rows.where(F.col("section") == "ROOT").agg(F.min(F.struct(*_order(), "title", "description")).alias("r"))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    return first.select(F.concat(F.lit("# "), text("title"), F.lit("\n\n> "), text("description"), F.lit("\n\n")).alias("head"))


def render(rows: DataFrame) -> DataFrame:
    """One row ``report``: the head, then the sections in ascending order."""
    body = section_texts(rows).agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("ss"))
    body = body.select(F.array_join(F.transform("ss", lambda x: x["text"]), "").alias("body"))
    return root_head(rows).crossJoin(body).select(F.concat("head", "body").alias("report"))  # one row each


def render_rows(rows: DataFrame) -> DataFrame:
    """``section, n, s, text`` in order: the rows that ``render`` puts into one, for reports beyond one task; the head comes first, with a null section.

    They are dealt by ranges; a section's heading is a row of its own, with null ``n`` and ``s``.
    """
    entries = _listed(rows)
    first = lambda c: F.lit(None).cast(entries.schema[c].dataType).alias(c)
    heads = entries.select("section").distinct().select("section", first("n"), first("s"), _heading().alias("text"))
    top = root_head(rows).select(first("section"), first("n"), first("s"), F.col("head").alias("text"))
    every = top.unionByName(heads).unionByName(entries.select("section", "n", "s", F.col("line").alias("text")).where("text IS NOT NULL"))
    return every.orderBy(*[F.col(c).asc_nulls_first() for c in ("section", "n", "s", "text")])


def report(pages: DataFrame, include=(), exclude=(), max_pages: int = 0, full: bool = False, seq: str = "page_id", closed: bool = False) -> DataFrame:
    """Addresses are filtered and limited before any page is parsed."""
    chosen = limit_urls(filter_urls(pages, include, exclude), max_pages, seq)
    return render(page_rows(chosen, full, seq, closed))
