"""The cache table: no writer loses anything, an update costs what it brings, a look-up opens its buckets."""

import datetime
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.sources import stores
from folio.sources.cache_table import CacheTable
from folio.streaming import documents

T0 = datetime.datetime(2025, 1, 1)


def entries(spark, *rows):
    """Rows of path, url, minutes."""
    data = [(p, f"k/{u}", u, "h", None if m is None else T0 + datetime.timedelta(minutes=m)) for p, u, m in rows]
    return spark.createDataFrame(data, "local_path string, remote_path string, url string, hash string, upload_time timestamp")


def held(table):
    return {r["local_path"]: r["url"] for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    return CacheTable(spark, (tmp_path / "cache").as_uri(), buckets=4)


def test_changes_add_up(spark, table):
    assert held(table) == {} and table.compact() == []
    table.put(entries(spark, ("a", "1", 1), ("b", "1", 1), (None, "x", 1), ("c", "1", None)))
    table.put(entries(spark, ("a", "3", 3), ("a", "2", 2), ("b", "0", 0), ("c", "2", 0)))
    want = {"a": "3", "b": "1", "c": "2"}
    assert held(table) == want
    table.remove(spark.createDataFrame([("a",), ("zz",), (None,)], "local_path string"), F.lit(T0 + datetime.timedelta(minutes=4)))
    table.remove(spark.createDataFrame([("b",)], "local_path string"), F.lit(T0))
    want.pop("a")
    assert held(table) == want
    assert len(table.compact(every=True)) == 4 and len(table.deltas()) == 1 and held(table) == want
    table.put(entries(spark, ("a", "old", 3)))
    assert held(table) == want
    table.put(entries(spark, ("a", "new", 5)))
    assert held(table) == {**want, "a": "new"}
    assert table.vacuum() == 0 and table.vacuum(0) >= 4 and held(table) == {**want, "a": "new"}


def test_a_named_change_is_made_once(spark, table):
    for url in "12":
        table.put(entries(spark, ("a", url, int(url))), "batch-7")
    assert held(table) == {"a": "1"} and len(table.deltas()) == 1


def test_two_writers_at_once_lose_nothing(spark, table):
    def write(k):
        for i in range(3):
            table.put(entries(spark, (f"{k}-{i}", "u", i), ("shared", f"{k}-{i}", 10 * i + k)))
            table.compact()

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(table) == {**{f"{k}-{i}": "u" for k in range(3) for i in range(3)}, "shared": "2-2"}


def test_compactions_that_overlap(spark, table):
    for i in range(4):
        table.put(entries(spark, ("a", str(i), i), (f"p{i}", "u", i)))
    want = held(table)
    first = CacheTable(spark, table.uri, 4)
    seen = first.deltas()
    first.deltas = lambda: seen  # a compaction that has not heard of the other
    table.compact(every=True)
    first.compact(every=True)
    assert len(table.deltas()) == 2 and held(table) == want
    table.compact(every=True)
    assert len(table.deltas()) == 1 and held(table) == want


def test_an_update_costs_what_it_brings(spark, table):
    table.put(entries(spark, *((f"p{i}", "u", i) for i in range(3_000))))
    sizes = []
    for k in range(3):
        before = {p for p in Path(table.uri.removeprefix("file://"), "data").rglob("*.parquet")}
        table.put(entries(spark, (f"new{k}", "u", k)))
        assert table.compact() == [] or k > 0  # the large delta is left alone
        new = [p for p in Path(table.uri.removeprefix("file://"), "data").rglob("*.parquet") if p not in before]
        sizes.append(sum(p.stat().st_size for p in new))
    assert max(sizes) < 20_000 and table.read().count() == 3_003 and len(table.deltas()) <= 3


def test_a_lookup_opens_the_buckets_of_its_paths(spark, table):
    table.put(entries(spark, *((f"p{i}", f"u{i}", i) for i in range(100))))
    got = table.lookup(spark.createDataFrame([("p7",), ("p7",), ("none",), (None,)], "local_path string"))
    assert [(r["local_path"], r["url"]) for r in got.collect()] == [("p7", "u7")]
    one = table.lookup(spark.createDataFrame([("p7",)], "local_path string"))
    files = {p for p in Path(table.uri.removeprefix("file://"), "data").rglob("*.parquet")}
    assert len(files) == 4
    for p in files:  # every other bucket is made unreadable
        if f"/bucket={spark.sql('SELECT pmod(xxhash64(\"p7\"), 4)').first()[0]}/" not in str(p):
            p.write_bytes(b"broken")
    assert one.count() == 1 and table.lookup(spark.createDataFrame([], "local_path string")).count() == 0


def test_a_stream_keeps_the_cache(spark, tmp_path):
    at, source = (tmp_path / "cache").as_uri(), str(tmp_path / "in")
    schema = entries(spark).schema
    for k in range(3):
        entries(spark, ("a", f"a{k}", k), (f"p{k}", "u", k)).coalesce(1).write.mode("append").parquet(source)
    stream = lambda to: documents.keep_cache(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), at, str(tmp_path / to), compact_every=2)
    stream("checkpoint").awaitTermination()
    want = {"a": "a2", "p0": "u", "p1": "u", "p2": "u"}
    assert held(CacheTable(spark, at)) == want
    stream("another").awaitTermination()  # all batches again
    assert held(CacheTable(spark, at)) == want
    assert {r["local_path"]: r["url"] for r in stores.read_cache(spark, at).collect()} == want
