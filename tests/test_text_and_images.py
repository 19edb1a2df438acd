from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.operators import images, publish


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_text(spark):
    assert column(spark, [" \t　a ", "​x", None], tx.trim) == ["a", "​x", None]
    assert column(spark, ["", "a\n", "a\nb"], lambda c: F.to_json(tx.lines(c))) == ['[""]', '["a",""]', '["a","b"]']
    assert column(spark, ["it's foo-BAR x1y élan", "", "a.b_c"], tx.title_case) == ["It'S Foo-BAR X1y Élan", "", "A.B_c"]
    assert column(spark, ["éa", "ABC", ""], tx.capitalise) == ["Éa", "Abc", ""]
    assert column(spark, ["a$1b$1", "zz", "$1"], lambda c: tx.replace_first(c, F.lit("$1"), F.lit("\\0"))) == ["a\\0b$1", "zz", "\\0"]
    assert column(spark, ["a/../b/./c", "/../x", "../a", "a//b/", "", "/"], tx.clean_path) == ["b/c", "/x", "../a", "a/b", ".", "/"]
    assert column(spark, ["a/b.md", "b.md", "/b"], tx.file_dir) == ["a", ".", "/"]
    assert column(spark, ["a.b/c", "x.tar.gz", ".p"], tx.extension) == ["", ".gz", ".p"]


def test_references(md):
    rows = images.references(md("![a](b \"t\") ![](c)", "none", None), "doc_id").orderBy("pos").collect()
    assert [(r["alt"], r["url"]) for r in rows] == [("a", 'b "t"'), ("", "c")]


def test_names(spark):
    urls = ["https://h/a/b.png?x=1", "https://h/a/pic.png@2x", "https://h/a/", "https://h/b@2x.png", "https://h/i.png#f"]
    assert column(spark, urls, images.file_name) == ["b.png", "pic.png", "image", "b@2x.png", "i.png#f"]
    assert column(spark, [urls[0], urls[2]], lambda c: images.unique_name(images.file_name(c), c)) == ["b_fc991961.png", "image_8115c3c0"]
    assert column(spark, ['attachment; filename="z.gif"', "inline", None], lambda c: images.file_name(F.lit(urls[0]), c)) == ["z.gif", "b.png", "b.png"]
    assert column(spark, ["My Photo (1)", "__a  b__", "日本", "a" * 60], images.clean_name) == ["My_Photo_1", "a_b", "", "a" * 50]
    assert column(spark, ["a.JPG", "a.svg", "a"], images.content_type) == ["image/jpeg", "image/svg+xml", "application/octet-stream"]
    assert column(spark, ["//x/y", "ftp://x", "http://x"], images.remote_url) == ["https://x/y", None, "http://x"]


def test_rewrite_folds_in_order(md):
    docs = md("![](a) ![](a)", "x")
    refs = images.references(docs, "doc_id").select("doc_id", "pos", F.col("full_match").alias("old"), F.concat(F.lit("$\\"), "pos").alias("new"))
    assert [r["content"] for r in images.rewrite(docs, refs).orderBy("doc_id").collect()] == ["$\\0 $\\1", "x"]


def test_export_paths(spark):
    docs = spark.createDataFrame([(1, "/w/d/a.md", "![p](i.png) ![q](no.png) ![w](http://x/i.png) ![]()")], "doc_id long, path string, content string")
    files = spark.createDataFrame([("/w/d/i.png",)], "path string")
    assert images.export_paths(docs, files, "/w").first()["content"] == "![p](d/i.png) ![q](no.png) ![w](http://x/i.png) ![]()"


def test_public_url(spark):
    cases = [("", "cdn.x"), ("http://h:9000/", ""), ("h", ""), ("", ""), ("https://acc.r2.dev", "")]
    df = spark.createDataFrame(cases, "e string, d string")
    got = [r[0] for r in df.select(publish.public_url(F.lit("k"), F.lit("b"), F.col("e"), F.lit("r"), F.col("d"), F.lit(""))).collect()]
    assert got == ["https://cdn.x/k", "http://h:9000/b/k", "https://h/b/k", "https://b.s3.r.amazonaws.com/k", "https://pub-b.acc.r2.dev/k"]


def test_versions(spark):
    keys = spark.createDataFrame([("a_1.png",), ("b.png",), ("c",)], "remote_path string")
    listing = spark.createDataFrame([(k, None, None) for k in ("a_1.png", "a_1_v1.png", "b_v2.png", "c_v1", "c_v2")], "key string, hash string, etag string")
    got = {r["remote_path"]: r["free_path"] for r in publish.least_free_versions(keys, listing).collect()}
    assert got == {"a_1.png": "a_1_v2.png", "b.png": "b_v1.png", "c": "c_v3"}


def test_upload_plan(spark, tmp_path):
    from folio.plans.commands import download, upload
    from folio.sources.stores import CACHE, LocalStore

    (tmp_path / "i.png").write_bytes(b"img")
    (tmp_path / "j.png").write_bytes(b"other")
    docs = spark.createDataFrame([(1, f"{tmp_path}/a.md", "![x](i.png) ![y](gone.png) ![w](https://x/y.png) ![z](j.png)")], "doc_id long, path string, content string")
    from folio.sources.files import manifest

    root, cache = str(tmp_path / "store"), spark.createDataFrame([], CACHE)
    store = LocalStore(root)
    listing = spark.createDataFrame([], "key string, hash string, etag string")
    up = upload(docs, manifest(spark, str(tmp_path)).where("path LIKE '%.png'"), cache, listing, lambda k: F.concat(F.lit("https://c/"), k), lambda: LocalStore(root))
    content = up.documents.first()["content"]
    key = [r["final_path"] for r in up.results.collect()]
    assert all(store.exists(k) for k in key) and len(key) == 2
    assert "gone.png" in content and "https://x/y.png" in content and "i.png)" not in content.replace("_", " ").split("https://x/y.png")[0].split("gone")[0].replace(key[0], "")
    s = up.statistics.first()
    assert (s["total"], s["uploaded"], s["skipped"], s["failed"], s["changed"]) == (1, 2, 0, 0, 1)
    assert up.missing.count() == 1 and up.cache.count() == 2
    again = upload(docs, manifest(spark, str(tmp_path)).where("path LIKE '%.png'"), up.cache, store.listing(spark), lambda k: k, lambda: LocalStore(root))
    assert again.results.count() == 0 and again.statistics.first()["skipped"] == 2
    reused = upload(docs, manifest(spark, str(tmp_path)).where("path LIKE '%.png' AND path NOT LIKE '%store%'"), cache, store.listing(spark), lambda k: k, lambda: LocalStore(root))
    assert {r["action"] for r in reused.results.collect()} == {"reuse"}

    def get(url):
        if "bad" in url:
            raise OSError("no")
        return {"body": b"x", "content_type": "image/png"}

    pages = spark.createDataFrame([(1, "/w/a.md", "![x](https://h/p) ![b](https://bad/q) ![](l.png)")], "doc_id long, path string, content string")
    new, files = download(pages, get)
    assert new.first()["content"].startswith("![x](images/p_") and "![b](https://bad/q)" in new.first()["content"]
    assert [r["file"].endswith(".png") for r in files.collect()] == [True]


def test_relative_path(spark):
    import posixpath

    paths = ["/", "/a", "/a/b/../c", "/a/b", "/ab", "a", "a/b", "./a//c", ".", "b/c/d", "/a/b/c/d"]
    pairs = [(t, f) for t in paths for f in [*paths, ""] if t.startswith("/") == f.startswith("/")]
    df = spark.createDataFrame(pairs, "t string, f string")
    for r in df.select("t", "f", images.relative_path(F.col("t"), F.col("f")).alias("r")).collect():
        assert r["r"] == posixpath.relpath(r["t"], r["f"] or "."), r
    assert spark.createDataFrame([("/a/./b", "c"), ("x", "/c")], "t string, f string").select(images.relative_path(F.col("t"), F.col("f"))).collect() == [("/a/b",), ("x",)]
    assert spark.createDataFrame([(None, "c"), ("x", None)], "t string, f string").select(images.relative_path(F.col("t"), F.col("f"))).collect() == [(None,), (None,)]
