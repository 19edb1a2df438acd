"""The data source for site maps, and how many addresses a read opens."""

import os
import tempfile
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.sources import sitemap, sitemap_source

URLSET = "<urlset xmlns='u'>{}</urlset>"
LOG = os.path.join(tempfile.gettempdir(), f"folio-sitemap-log-{os.getuid()}")
BODIES = {
    "https://x/index": (200, "<sitemapindex>" + "".join(f"<sitemap><loc>https://x/{c}</loc></sitemap>" for c in ("a", "b", "gone", "nested", "c")) + "</sitemapindex>"),
    "https://x/a": (200, URLSET.format("<url><loc>https://x/a/1</loc><lastmod>d</lastmod></url><url><loc></loc></url><url><loc>https://x/a/2?q=1&amp;r</loc></url>")),
    "https://x/b": (500, URLSET.format("".join(f"<url><loc>https://x/b/{i}</loc></url>" for i in range(5)))),
    "https://x/nested": (200, "<sitemapindex><sitemap><loc>https://x/a</loc></sitemap></sitemapindex>"),
    "https://x/c": (200, "<?xml version='1.0'?>" + URLSET.format("<url><priority>1</priority><loc><![CDATA[https://x/c/1]]></loc></url><url><loc>https://x/a/1</loc></url>")),
    "https://x/text": (200, "https://x/1\n\nhttps://x/2\r\n"),
    "https://x/bad": (404, ""),
    "https://x/none": (200, ""),
}


def get(address):
    Path(LOG).mkdir(exist_ok=True)
    Path(LOG, f"{address.rpartition('/')[2]}~{uuid.uuid4().hex}").touch()
    return BODIES[address]


@pytest.fixture
def read(spark):
    sitemap_source.register(spark)
    before = set(os.listdir(LOG)) if os.path.isdir(LOG) else set()
    opened = lambda: sorted(n.partition("~")[0] for n in set(os.listdir(LOG)) - before)
    return lambda start, **options: (spark.read.format("sitemap").options(get="test_sitemap_source:get", **options).load(f"https://x/{start}"), opened)


@pytest.mark.parametrize("start", ["index", "a", "text", "none"])
def test_rows_are_those_of_the_expression(spark, read, start):
    bodies = spark.createDataFrame([(u, b, s) for u, (s, b) in BODIES.items()], "url string, body string, status int")
    want = [tuple(r) for r in sitemap.expand(bodies, f"https://x/{start}").orderBy("seq").collect()]
    got = [tuple(r) for r in read(start)[0].drop("map").orderBy("seq").collect()]
    assert got == want and (got or start == "none")


def test_a_map_that_cannot_be_had(read):
    with pytest.raises(Exception, match="status 404"):
        read("bad")[0].collect()


@pytest.mark.parametrize(
    ("condition", "opened"),
    [("map = 'https://x/b'", ["b"]), ("map IN ('https://x/a', 'https://x/c')", ["a", "c"]), ("startswith(map, 'https://x/n')", ["nested"]), ("map = 'https://x/zzz'", []), ("loc LIKE '%/b/%' AND map = 'https://x/b'", ["b"])],
)
def test_a_condition_on_the_map_opens_fewer(read, condition, opened):
    df, log = read("index")
    rows = df.where(condition).collect()
    assert {n for n in log() if n != "index"} == set(opened)
    assert {r["map"] for r in rows} <= {f"https://x/{n}" for n in opened} and (rows or opened in ([], ["nested"]))


def test_limit_opens_maps_in_order_until_it_is_met(read):
    df, log = read("index", limit=4)
    assert [r["loc"] for r in df.orderBy("seq").collect()] == ["https://x/a/1", "https://x/a/2?q=1&r", "https://x/b/0", "https://x/b/1"]
    assert set(log()) == {"index", "a", "b"}


def test_globs(read):
    assert read("index", include='["**/b/[!0-2]", "[bad"]', exclude='["*4"]')[0].select("loc").collect() == [("https://x/b/3",)]
    assert read("text", exclude='["*1"]')[0].count() == 1


def test_a_partition_is_a_map(spark, read):
    df, _ = read("index")
    assert df.rdd.getNumPartitions() == 5
    assert df.withColumn("task", F.spark_partition_id()).groupBy("map").agg(F.count_distinct("task").alias("n")).where("n > 1").isEmpty()


def test_files_are_addresses_too(spark, tmp_path):
    sitemap_source.register(spark)
    (tmp_path / "m.xml").write_text(URLSET.format("<url><loc>https://x/é</loc></url>"))
    assert spark.read.format("sitemap").load((tmp_path / "m.xml").as_uri()).first()["loc"] == "https://x/é"
