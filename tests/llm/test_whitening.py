"""Whitening against exact fractions and a plain covariance over the whole fit list."""

from fractions import Fraction

import numpy as np
import pytest

from folio.llm import whitening
from folio.llm.queries import QUERIES

NAME = "op11_embedding_whitening"


def brute(rows, components=16):
    """vec_id, n, deviation and, by component, whitened (sign of its own), explained, of rows of one length."""
    whole = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in whole})
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    off = lambda x: [n * a - s for a, s in zip(x, sums, strict=True)]
    centred = np.array([[float(Fraction(o, n)) for o in off(x)] for x in listed])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = {}
    for i, x in whole:
        w = np.array([float(Fraction(o, n)) for o in off(x)]) @ u / np.sqrt(e)
        out.setdefault(i, []).append((n, sum(o * o for o in off(x)), w, e / np.trace(cov)))
    return out


def by_id(df):
    found = {}
    for r in df.orderBy("component").collect():
        found.setdefault(r["vec_id"], []).append(r)
    return found


def check(got, want, copies=1):
    assert set(got) == set(want)
    signs = None
    for i, rows in got.items():
        n, deviation, w, explained = want[i][0]
        rows = rows[::copies]
        assert [r["component"] for r in rows] == list(range(1, len(w) + 1))
        assert {(r["n"], r["deviation"]) for r in rows} == {(n, deviation)}
        mine = np.array([r["whitened"] for r in rows])
        if signs is None or (np.abs(w) > 0.1).all():
            own = np.sign(mine * w)
            assert signs is None or np.abs(w).min() < 0.1 or (own == signs).all()
            signs = own
        assert np.allclose(np.abs(mine), np.abs(w), atol=1e-7)
        assert np.allclose([r["explained"] for r in rows], explained, rtol=1e-9)
        assert {r["identity_error"] <= 1e-4 for r in rows} == {True}


def test_whole_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    df = QUERIES[NAME](spark, sf_dir)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(by_id(df), brute(rows))


SCHEMA = "vec_id long, embedding array<float>, label int, n string, code int"


def folder(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame([(i, v, 0, "x", 1)[: schema.count(",") + 1] for i, v in rows], schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_copies_count_once_and_awkward_rows_go(spark, tmp_path):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(300)]
    rows = [*good, *[(1_000 + i, good[0][1]) for i in range(400)], (9_000, None), (9_001, [None, 1.0, 1.0, 1.0, 1.0]), (9_002, [float("nan")] * 5), (9_003, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (9_004, [])]
    got = by_id(QUERIES[NAME](spark, folder(spark, tmp_path, rows)))
    check(got, brute(rows[:-1]))
    assert next(iter(got.values()))[0]["n"] == 300 and len(got) == 700


def test_ids_null_and_repeated(spark, tmp_path):
    rows = [(None if i < 2 else 7, [float(i), float(i * i % 5)]) for i in range(9)]
    got = QUERIES[NAME](spark, folder(spark, tmp_path, rows)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["7"] * 14 + ["None"] * 4


def test_lengths_and_ranks(spark, tmp_path):
    """Each length has a fit of its own; constant entries, single and equal vectors have no component."""
    rng = np.random.default_rng(2)
    three = [(i, [*map(float, rng.normal(size=2)), 0.5]) for i in range(50)]
    rows = [*three, (100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [3.0])]
    got = by_id(QUERIES[NAME](spark, folder(spark, tmp_path, rows)))
    assert set(got) == set(range(50)) and {len(r) for r in got.values()} == {2}
    check(got, brute(three, 2))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [2.0])]])
def test_empty(spark, tmp_path, rows):
    df = QUERIES[NAME](spark, folder(spark, tmp_path, rows))
    assert df.collect() == [] and df.columns[:2] == ["vec_id", "component"]


def test_large_entries(spark, tmp_path):
    """Sums and deviations stay exact beyond 32 and 64 bits, and what does not fit a long is null."""
    rows = [(0, [1e9, 1.0]), (1, [-1e9, 2.0]), (2, [3e7, 2.5]), (3, [1e300, 0.0]), (4, [-1e300, 1.0])]
    fits, _ = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert fits[2].sums == [64 * 30_000_000, 64 + 128 + 160 + 64]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()}
    want = brute(rows[:3], 2)
    assert {i: r["deviation"] for i, r in got.items()} == {i: w[0][1] if w[0][1] < 1 << 63 else None for i, w in want.items()}
    y = np.array([[1 << 40, 5], [-3, 4]])
    for own in (whitening.Fit(3, [7, -8]), whitening.Fit(10**12, [10**15, 3])):
        exact = [sum((own.n * int(a) - s) ** 2 for a, s in zip(r, own.sums, strict=True)) for r in y]
        assert own.deviation(y) == [x if x < 1 << 63 else None for x in exact]


def test_small_spread_far_from_zero(spark, tmp_path):
    """Centring comes before multiplying: a spread of a millionth of the mean is whitened as well."""
    rng = np.random.default_rng(3)
    rows = [(i, [1e6 + float(a) / 64, -1e6 + float(b) / 64, float(c) / 64]) for i, (a, b, c) in enumerate(rng.integers(0, 50, (200, 3)))]
    check(by_id(QUERIES[NAME](spark, folder(spark, tmp_path, rows, "vec_id long, embedding array<double>"))), brute(rows))
