"""Registered queries of the training-data operators against their SQL, on the smallest tables and on awkward rows."""

import duckdb
import pytest

from folio.llm.queries import QUERIES, SQL

TABLES = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>, label int"}


def same(spark, name, folder):
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    with duckdb.connect() as duck:
        for table in TABLES:
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{'' if folder == str(folder) else '/*.parquet'}'")
        want = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op6_vector_near_dedup"])
def test_smallest_tables(spark, sf_dir, name):
    assert same(spark, name, sf_dir)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    text = " ".join(f"Word{i}" for i in range(60))
    texts = [text, text.lower(), text + " more", None, "", " \t", "one two", "One  two", "one two three", text[60:], "x " * 5000, "x " * 5001]
    v = [float(i % 7) for i in range(64)]
    vectors = [v, v, [2 * x for x in v], [x + 0.1 for x in v], [-x for x in v], None, [], [0.0] * 64, [None, *v[1:]], [float("nan"), *v[1:]], [1.0, 2.0]]
    folder = tmp_path_factory.mktemp("awkward")
    rows = {"documents": [(i, t, "en", None, 0) for i, t in enumerate([*texts, *texts[:2]])], "embeddings": [(i, x, 0) for i, x in enumerate(vectors)]}
    for table, schema in TABLES.items():
        spark.createDataFrame(rows[table], schema).write.parquet(str(folder / f"{table}.parquet"))
    return folder


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op6_vector_near_dedup"])
def test_awkward_rows(spark, awkward, name):
    assert len({r[0] for r in same(spark, name, awkward)}) > 3
