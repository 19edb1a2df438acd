"""Site maps as a data source: ``spark.read.format("sitemap")``.

    register(spark)
    spark.read.format("sitemap").option("include", '["**/docs/**"]').load("https://host/sitemap.xml")

Planning opens the map itself; each url set that an index names is a partition, opened by the task that reads it, so the set is never in one place.  Rows are
``seq, loc, lastmod, changefreq, priority, map``, as ``sitemap.expand`` gives them, with the address of the url set.

Conditions on ``map`` (equal, among, begins with) are met at planning: other url sets are not opened.  Globs for addresses (``include``, ``exclude``: JSON lists) are met where an
address is read.  With ``limit`` the url sets are opened in order, in one task, until so many addresses are found
(before conditions that Spark checks).  ``get`` names a function (``module:name``) of an address that
returns status and body; without it addresses are read by HTTP or, with other schemes, by Arrow's file systems.

Defined cases: a map that cannot be had, or has another status than 200, fails the query; a url set that cannot be had gives no rows; an index within an index is not followed;
entries without an address are left out but count for ``seq``; a body of neither kind is read as lines; repeated addresses stay.  Each action opens the addresses
anew, as for any source: write what was read if it is to be read again.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from folio.operators.urls import glob_to_regex

FIELDS = ("loc", "lastmod", "changefreq", "priority")
#: Partitions at most; beyond it, neighbouring url sets share one.
MOST = 10_000
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def open_address(address: str) -> tuple[int, str]:
    """Status and body over HTTP, or of a file on a file system that Arrow reaches."""
    if re.match(r"https?://", address):
        from urllib.request import Request, urlopen

        with urlopen(Request(address, headers={"User-Agent": "folio"}), timeout=30) as r:
            return r.status, r.read().decode("utf-8", "replace")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub(r"\As3[an]://", "s3://", address))
    with store.open_input_stream(at) as f:
        return 200, f.read().decode("utf-8", "replace")


def entries(body: str, root: str, item: str, fields: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The fields of each item of a document that has this root; empty ones where they are missing."""
    if not (re.match(r"\s*<", body) and re.search(rf"<(?:\w+:)?{root}[\s>]", body)):
        return []
    out = []
    for part in re.findall(rf"(?s)<(?:\w+:)?{item}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{item}>", body):
        row = []
        for f in fields:
            found = re.search(rf"(?s)<(?:\w+:)?{f}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</(?:\w+:)?{f}>", part)
            text = found.group(1) if found else ""
            for entity, char in _ENTITIES:
                text = text.replace(entity, char)
            row.append(text)
        out.append(tuple(row))
    return out


def matcher(include: list[str], exclude: list[str]) -> Callable[[str], bool]:
    """Whether an address is wanted: by any of the globs to include, if one is valid, and by none to exclude."""
    patterns = [[re.compile(p.replace(r"\z", r"\Z")) for p in map(glob_to_regex, globs) if p is not None] for globs in (include, exclude)]
    return lambda a: (not patterns[0] or any(p.match(a) for p in patterns[0])) and not any(p.match(a) for p in patterns[1])


@dataclass
class Part(InputPartition):
    """Numbers and addresses of url sets; ``rows`` instead, where the map holds the addresses itself."""

    maps: list[tuple[int, str]]
    rows: list[tuple] | None = None


class SitemapReader(DataSourceReader):
    def __init__(self, options):
        self.start, self.getter = options["path"], options.get("get", f"{__name__}:open_address")
        self.limit = int(options.get("limit", 0))
        self.globs = [json.loads(options.get(k, "[]")) for k in ("include", "exclude")]
        self.kept: list[tuple[str, tuple]] = []  # conditions on ``map``

    def _get(self, address: str) -> tuple[int, str]:
        module, _, name = self.getter.partition(":")
        return getattr(importlib.import_module(module), name)(address)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == ("map",) and isinstance(f, EqualTo):
                self.kept.append(("among", (f.value,)))
            elif f.attribute == ("map",) and isinstance(f, In):
                self.kept.append(("among", tuple(f.value)))
            elif f.attribute == ("map",) and isinstance(f, StringStartsWith):
                self.kept.append(("begins", (f.value,)))
            else:
                yield f

    def _wanted(self, address: str) -> bool:
        return all(address in values if how == "among" else address.startswith(values[0]) for how, values in self.kept)

    def partitions(self) -> list[Part]:
        status, body = self._get(self.start)
        if status != 200:
            raise OSError(f"{self.start}: status {status}")
        found = entries(body, "urlset", "url", FIELDS)
        children = [] if found else entries(body, "sitemapindex", "sitemap", ("loc", "lastmod"))
        if not children:
            rows = found or [(line, "", "", "") for line in body.split("\n") if line]
            return [Part([], [(i, *r, self.start) for i, r in enumerate(rows)] if self._wanted(self.start) else [])]
        maps = [(i, loc) for i, (loc, _) in enumerate(children) if self._wanted(loc)]
        step = len(maps) if self.limit else -(-len(maps) // MOST)
        return [Part(maps[a : a + step]) for a in range(0, len(maps), max(step, 1))] or [Part([])]

    def _rows(self, part: Part) -> Iterator[tuple]:
        yield from part.rows or ()
        for number, address in part.maps:
            try:
                _, body = self._get(address)
            except Exception:  # a url set that cannot be had is left out
                continue
            for i, row in enumerate(entries(body, "urlset", "url", FIELDS)):
                yield ((number << 32) + i, *row, address)

    def read(self, partition: Part) -> Iterator[tuple]:
        wanted, n = matcher(*self.globs), 0
        for row in self._rows(partition):
            if row[1] and wanted(row[1]):
                yield row
                n += 1
                if n == self.limit:
                    return


class SitemapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def schema(self) -> str:
        return "seq long, loc string, lastmod string, changefreq string, priority string, map string"

    def reader(self, schema) -> SitemapReader:
        return SitemapReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with conditions handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SitemapSource)
