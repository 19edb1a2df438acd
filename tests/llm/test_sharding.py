"""The uniform shuffle against its law: exact sizes, every place used once, and no trace of the input's order."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import sharding
from folio.llm.queries import QUERIES


def test_matrix_has_its_sums():
    rng = np.random.default_rng(3)
    for rows, columns in (([5, 0, 7, 1], [4, 4, 5]), ([0, 0], [0, 0, 0]), ([3], [1, 1, 1]), ([], [0]), ([10**6] * 40, [10**7] * 4)):
        got = sharding.matrix(rng, rows, np.array(columns))
        assert got.sum(axis=1).tolist() == rows and (got >= 0).all()
        assert not rows or got.sum(axis=0).tolist() == columns


def test_matrix_is_hypergeometric():
    rng = np.random.default_rng(4)
    got = np.array([sharding.matrix(rng, [30, 10, 20], np.array([15, 25, 20])) for _ in range(4_000)])
    mean = np.outer([30, 10, 20], [15, 25, 20]) / 60
    share = np.array([15, 25, 20]) / 60
    spread = np.array([[n * s * (1 - s) * (60 - n) / 59 for s in share] for n in (30, 10, 20)])
    assert np.abs(got.mean(axis=0) - mean).max() < 5 * (spread.max() / 4_000) ** 0.5
    assert np.abs(got.var(axis=0) / spread - 1).max() < 0.15


def test_large_populations(monkeypatch):
    rng = np.random.default_rng(5)
    exact = [rng.hypergeometric(400, 600, 100) for _ in range(4_000)]
    monkeypatch.setattr(sharding, "LARGE", 10)
    own = [sharding.hypergeometric(rng, 400, 600, 100) for _ in range(4_000)]
    edges = [0, 33, 36, 38, 40, 42, 44, 47, 101]
    a, b = np.histogram(exact, edges)[0], np.histogram(own, edges)[0]
    assert ((a - b) ** 2 / (a + b)).sum() < 30  # 7 degrees of freedom
    assert {sharding.hypergeometric(rng, g, b, n) for g, b, n in ((0, 20, 5), (20, 0, 0))} == {0}
    assert sharding.hypergeometric(rng, 20, 0, 7) == 7 and sharding.hypergeometric(rng, 20, 20, 40) == 20
    monkeypatch.undo()
    n, good, bad = 10**10, 4 * 10**10, 6 * 10**10
    z = [(sharding.hypergeometric(rng, good, bad, n) - 0.4 * n) / (n * 0.24 * 0.9) ** 0.5 for _ in range(40)]
    assert abs(np.mean(z)) < 1 and 0.5 < np.std(z) < 1.6
    assert sharding.draw(rng, np.array([10**9, 10**9, 10**9]), 3 * 10**9).tolist() == [10**9] * 3


def placed(spark, n, splits, **how):
    rows = spark.range(0, n, 1, splits).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("x").alias("slot"), F.lit(1).alias("shard"))
    return sharding.shuffled(rows, **how).select("row.doc_id", "shard", "chunk", "slot", F.spark_partition_id().alias("task")).toPandas()


@pytest.mark.parametrize(("n", "splits", "shards", "chunk"), [(20_000, 8, 24, 50), (20_000, 8, 3, 100_000), (1_000, 1, 7, 40), (5, 3, 24, 10), (0, 1, 24, 10)])
def test_places_are_exact(spark, n, splits, shards, chunk):
    got = placed(spark, n, splits, shards=shards, chunk=chunk)
    assert sorted(got["doc_id"]) == list(range(n))
    assert got.groupby("shard").size().to_dict() == {s: int(k) for s, k in enumerate(sharding.shard_sizes(n, shards)) if k}
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert got.groupby("chunk")["task"].nunique().max() == 1 if n else True
    assert (got.groupby("chunk")["slot"].agg(lambda x: x.max() - x.min() + 1) == got.groupby("chunk").size()).all() and (n == 0 or got.groupby("chunk").size().max() <= chunk)


def test_nothing_is_left_of_the_order(spark):
    """Ranks of the input, its partitions and its neighbours against shards, chunks and slots; seeds differ and repeat."""
    n, splits, shards = 24_000, 6, 4
    a, again, b = (placed(spark, n, splits, shards=shards, chunk=500, seed=s).set_index("doc_id").sort_index() for s in (1, 1, 2))
    assert a.equals(again)
    place = [x["shard"].to_numpy() * (n // shards) + x["slot"].to_numpy() for x in (a, b)]
    for p in place:
        assert sorted(p) == list(range(n))
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 4 / n**0.5
        assert abs(np.corrcoef(p[:-1], p[1:])[0, 1]) < 4 / n**0.5
        cells = np.histogram2d(np.arange(n), p, bins=(24, 48))[0]
        chi, free = ((cells - cells.mean()) ** 2 / cells.mean()).sum(), 23 * 47
        assert abs(chi - free) < 5 * (2 * free) ** 0.5
        near = np.abs(np.diff(p)) == 1  # neighbours that stay neighbours: two a shuffle
        assert near.sum() < 15
    assert abs(np.corrcoef(*place)[0, 1]) < 4 / n**0.5


def test_groups_of_partitions(spark):
    got = placed(spark, 1_000, 10, shards=6, chunk=30, group=3)
    assert sorted(zip(got["shard"], got["slot"], strict=True)) == [(s, i) for s, k in enumerate(sharding.shard_sizes(1_000, 6)) for i in range(k)]


def test_whole_query_on_awkward_rows(spark, tmp_path):
    texts = ["", None, "é" * 300, "x" * 2_000_000, "same", "same", "same"]
    rows = [(None if i % 5 == 0 else i // 2, t, "en", None, 3) for i, t in enumerate(texts * 9)]
    spark.createDataFrame(rows, "doc_id long, text string, shard string, slot string, row long").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["op13_hypergeometric_shards"](spark, str(tmp_path))
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = df.collect()
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    assert sorted(map(str, ((r[0], r[1], r[2]) for r in got))) == sorted(str((i, len(b) + 8, zlib.crc32(b))) for i, b in data)
    assert {(r["shard"], r["slot"]) for r in got} == {(s, i) for s, k in enumerate(sharding.shard_sizes(63, 24)) for i in range(k)}
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_written_shards(spark, tmp_path):
    docs = spark.range(0, 500, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=5, chunk=30)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == dict.fromkeys(range(5), 100)
    assert back.where("row.text = concat('text ', row.doc_id)").count() == 500
    for f in (tmp_path / "out" / "shard=3").glob("*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))
