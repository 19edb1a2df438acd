"""Numbering in ranges with wide rows, and rows whose content or address is null."""

from pyspark.sql import functions as F

from folio.operators import lint, translate, urls


def test_numbers_do_not_depend_on_what_is_read_along(spark):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        docs = spark.range(2_000, numPartitions=5).select(F.concat(F.lit("d/"), F.md5(F.col("id").cast("string"))).alias("path"), F.repeat(F.md5(F.col("id").cast("string")), 80).alias("content"))
        docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("path", F.lit(None).cast("string")))
        for columns in (["path"], ["path", "content"]):
            got = translate.progress(docs.select(*columns)).orderBy("k").collect()
            assert [r["k"] for r in got] == list(range(1, 2_003)) and {r["n"] for r in got} == {2_002}
            assert [r["path"] for r in got] == sorted((r["path"] for r in got), key=lambda p: (p is not None, p or ""))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert translate.progress(docs.limit(0)).count() == 0


def test_null_content_and_addresses_stay(spark, md):
    fits, large = lint.size_guard(md("abc", None, "x" * 20), limit=10)
    assert (fits.count(), large.count()) == (2, 1)
    pages = spark.createDataFrame([("https://a/x",), ("https://b/x",), (None,)], "url string")
    assert urls.filter_urls(pages, exclude=["https://a/*"]).count() == 2
    assert urls.filter_urls(pages, include=["https://a/*"]).count() == 1
