"""Objects appear whole, once and with what they say about themselves; listings look into wanted keys only."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.sources import objects, stores


def held(root: Path) -> dict[str, bytes]:
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def rows(n):
    return [{"key": f"k{i % 3}/{i}.bin", "path": None, "content": b"x" * i, "metadata": {"Hash": f"h{i}"}} for i in range(n)]


def test_write_and_list(spark, tmp_path):
    (tmp_path / "file.txt").write_text("from a file")
    data = [("a/1.txt", None, b"one", {"Hash": "h1"}), ("a/b/2.txt", str(tmp_path / "file.txt"), None, {"Hash": "h2"}), ("top", None, None, None), ("a/gone", str(tmp_path / "none"), None, {}), (None, None, b"x", {}), ("../out", None, b"x", {})]
    store = stores.LocalStore(str(tmp_path / "s"))
    got = {r["key"]: r["error"] for r in objects.write_objects(spark.createDataFrame(data, objects.SCHEMA), store.uri).collect()}
    assert {k for k, e in got.items() if e is None} == {"a/1.txt", "a/b/2.txt", "top"} and got["a/gone"].startswith("FileNotFoundError") and "no key" in got["../out"] and "no key" in got[None]
    assert held(tmp_path / "s") == {"a/1.txt": b"one", "a/b/2.txt": b"from a file", "top": b"", "a/1.txt.meta": b'{"Hash": "h1"}', "a/b/2.txt.meta": b'{"Hash": "h2"}', "top.meta": b"{}"}
    assert {(r["key"], r["size"]) for r in objects.listed(spark, store.uri).collect()} == {("a/1.txt", 3), ("a/b/2.txt", 11), ("top", 0)}
    assert {r["key"]: (r["hash"], r["etag"] is not None) for r in store.listing(spark).collect()} == {"a/1.txt": ("h1", True), "a/b/2.txt": ("h2", True), "top": (None, True)}


def test_wanted_keys_only_are_looked_into(spark, tmp_path):
    store = stores.ArrowStore(tmp_path.as_uri())
    objects.write_objects(spark.createDataFrame([tuple(r.values()) for r in rows(40)], objects.SCHEMA), store.root)
    for p in (tmp_path / "k1").glob("*.meta"):
        p.write_text("{broken")
    wanted = objects.listed(spark, store.root).where("NOT startswith(key, 'k1/')").unionByName(spark.createDataFrame([("not/there", 1), ("k0/0.bin", 1)], "key string, size long"))
    got = {r["key"]: r["hash"] for r in store.listing(spark, wanted).collect()}
    assert got == {f"k{i % 3}/{i}.bin": None if i % 3 == 1 else f"h{i}" for i in range(40)}
    with pytest.raises(Exception, match="Expecting property name"):
        store.listing(spark).collect()


@pytest.mark.parametrize("n", [0, 1])
def test_empty(spark, tmp_path, n):
    uri = (tmp_path / "missing").as_uri()
    assert objects.listed(spark, uri).count() == 0 and stores.ArrowStore(uri).listing(spark, spark.createDataFrame([], "key string")).count() == 0
    assert objects.write_objects(spark.createDataFrame([("k", b"1")], "key string, content binary").limit(n), uri).count() == n
    assert objects.listed(spark, uri).count() == n


def test_repeated_keys_are_written_once(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text(name)
    data = [("k", str(tmp_path / "b")), ("k", str(tmp_path / "a"))] * 20
    done = objects.write_objects(spark.createDataFrame(data, "key string, path string").repartition(4), (tmp_path / "s").as_uri())
    assert [tuple(r) for r in done.collect()] == [("k", None)] and (tmp_path / "s" / "k").read_text() == "a"


def writer(root):
    return objects.ObjectWriter({"path": root.as_uri(), "job": "j"})


def test_a_task_that_dies_while_it_stages(spark, tmp_path):
    """The attempt that died has staged half of its objects; the next one is the one that counts."""

    def dying():
        yield from rows(5)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer(tmp_path).write(dying())
    assert all(k.startswith("_staging/") for k in held(tmp_path)) and objects.listed(spark, tmp_path.as_uri()).count() == 0
    message = writer(tmp_path).write(iter(rows(10)))
    writer(tmp_path).commit([message, None])
    assert objects.publish(spark, tmp_path.as_uri(), "j").where("error IS NULL").count() == 10
    assert set(held(tmp_path)) == {f"k{i % 3}/{i}.bin{s}" for i in range(10) for s in ("", ".meta")}


@pytest.mark.parametrize("done", [0, 1, 4, 10])
def test_a_task_that_dies_while_it_publishes(spark, tmp_path, done):
    """At every moment no metadata is without its object; the next attempt goes on where it was."""
    message = writer(tmp_path).write(iter(rows(10)))
    writer(tmp_path).commit([message])
    publishing = objects.publish_attempt(tmp_path.as_uri(), "j", message.attempt)
    for _ in range(done):
        next(publishing)
        now = {k for k in held(tmp_path) if not k.startswith("_staging")}
        assert all(k.removesuffix(".meta") in now for k in now)
    publishing.close()
    assert objects.recover(spark, tmp_path.as_uri()) == ["j"] and objects.recover(spark, tmp_path.as_uri()) == []
    assert held(tmp_path) == {k: v for r in rows(10) for k, v in ((r["key"], r["content"]), (r["key"] + ".meta", json.dumps(r["metadata"]).encode()))}


def test_a_job_without_commit_leaves_nothing(spark, tmp_path):
    writer(tmp_path).write(iter(rows(3)))
    assert objects.recover(spark, tmp_path.as_uri()) == [] and held(tmp_path) == {}
    writer(tmp_path).write(iter(rows(3)))
    writer(tmp_path).abort([])
    assert held(tmp_path) == {}


def test_a_failing_job_is_aborted(spark, tmp_path):
    """A column that cannot be computed fails its task; nothing of the job is left."""
    bad = spark.range(20).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") == 13, F.raise_error(F.lit("no row"))).cast("binary").alias("content"))
    with pytest.raises(Exception, match="no row"):
        objects.write_objects(bad, tmp_path.as_uri())
    assert held(tmp_path) == {}


def test_manifests_and_folders_are_read_piece_by_piece(spark, tmp_path, monkeypatch):
    """Neither the lines of an attempt nor the entries of a folder are held as one list."""
    from itertools import islice

    staged, written = [], []
    real, n = objects.write_file, 500

    def watch(store, at, chunks, metadata=None):
        chunks = list(chunks) if not at.endswith(objects.MANIFEST) else (written.append(len(staged)) or c for c in chunks)
        staged.append(at)
        return real(store, at, chunks, metadata)

    monkeypatch.setattr(objects, "write_file", watch)
    message = writer(tmp_path).write(iter(rows(n)))
    assert written[0] < n and len(written) == n  # the first line is written while most objects are to come
    writer(tmp_path).commit([message])
    publishing = objects.publish_attempt(tmp_path.as_uri(), "j", message.attempt)
    assert len(list(islice(publishing, 3))) == 3
    publishing.close()
    assert objects.recover(spark, tmp_path.as_uri()) == ["j"]
    store, root = objects.open_store(tmp_path.as_uri())
    found = objects.entries(store, f"{root}/k1")
    assert iter(found) is found and sum(name.endswith(".meta") for name, *_ in found) == len([i for i in range(n) if i % 3 == 1])
    assert list(objects.entries(store, f"{root}/none")) == []
    assert objects.listed(spark, tmp_path.as_uri()).count() == n
