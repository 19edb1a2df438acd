"""The cache document and the store on Arrow's file systems."""

import json

from folio.sources import config, stores


def test_cache_document(spark, tmp_path):
    at = str(tmp_path / "deep" / "c.json")
    assert stores.read_cache(spark, at).count() == 0 and json.loads(open(at).read()) == {"items": {}, "version": "1.0"}
    rows = [("b.png", "k/b", "https://x/b", "h1"), ("ä.png", "k/a", "https://x/a", None)]
    cache = spark.createDataFrame(rows, "local_path string, remote_path string, url string, hash string").selectExpr("*", "timestamp'2024-05-06 07:08:09.123' AS upload_time")
    stores.save_cache(cache, at)
    text = open(at, encoding="utf-8").read()
    assert json.loads(text)["items"]["ä.png"]["upload_time"].startswith("2024-05-06T07:08:09.123") and text.startswith('{\n  "items": {\n    "b.png"')
    assert sorted(map(tuple, stores.read_cache(spark, at).collect()), key=str) == sorted(map(tuple, cache.collect()), key=str)
    for broken in ("[]", '{"items": 3}', "{"):
        open(at, "w").write(broken)
        assert stores.read_cache(spark, at).count() == 0
    stores.write_cache(cache, str(tmp_path / "lines"))
    assert stores.read_cache(spark, str(tmp_path / "lines")).count() == 2


def test_arrow_store(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(b"1" * 3_000_000)
    store = stores.ArrowStore((tmp_path / "bucket").as_uri())
    assert store.listing(spark).count() == 0 and not store.exists("a/i.png") and store.metadata("a/i.png") == {}
    store.put("a/i.png", str(tmp_path / "i.png"), "image/png", {"Hash": "h1"})
    assert store.exists("a/i.png") and not store.exists("a") and (tmp_path / "bucket/a/i.png").read_bytes() == b"1" * 3_000_000
    assert store.metadata("a/i.png") == {"Content-Type": "image/png", "Hash": "h1"} and store.same("a/i.png", "h1") and not store.same("a/i.png", "h2") and not store.same("b", "h1")
    store.set_metadata("a/i.png", {"Hash": "h2"})
    assert [tuple(r) for r in store.listing(spark).collect()] == [("a/i.png", "h2", None)]


def test_address_of_configured_storage():
    s = config.Storage(region="eu-1", endpoint="https://s3.example:9000", access_key="a/b", secret_key="c+d", bucket="bk", path_prefix="/img/")
    assert stores.ArrowStore.of(s).root == "s3://a%2Fb:c%2Bd@bk/img?region=eu-1&scheme=https&endpoint_override=s3.example%3A9000"
    assert stores.ArrowStore.of(config.Storage(bucket="bk")).root == "s3://bk"
