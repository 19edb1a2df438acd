"""One file from ordered rows: byte for byte what one string would be."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.operators import llms, merge
from folio.sources.compose import compose

TEXTS = [[], [""], ["a"], [None], ["a", None, "b", "", "ü" * 700_000, "c"], [None, "x", None], [f"t{i}\n" * (i % 5) for i in range(200)]]


@pytest.mark.parametrize("by_offset", [True, False])
@pytest.mark.parametrize("separator", ["", "\n\n", "é"])
@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_same_bytes(spark, tmp_path, k, separator, by_offset):
    df = spark.createDataFrame(list(enumerate(TEXTS[k])), "k long, text string").repartition(3).orderBy("k")
    to = tmp_path / "out" / "f.md"
    n = compose(df, str(to), separator=separator, by_offset=by_offset)
    want = separator.join(t for t in TEXTS[k] if t is not None).encode()
    assert to.read_bytes() == want and n == len(want)
    assert [p.name for p in to.parent.iterdir()] == ["f.md"]


def test_merged_document_and_report(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"p{i:03d}.md", f"---\nx: {i}\n---\n# T{i}\n\ntext") for i in range(60)], "doc_id long, path string, content string").repartition(5)
    compose(merge.merge_rows(docs, 1, True, "path"), str(tmp_path / "m.md"), separator="\n\n")
    assert (tmp_path / "m.md").read_text() == merge.merge(docs, 1, True, "path").first()["merged"]
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.concat(F.lit("https://x/s"), F.col("id") % 3, F.lit("/"), "id").alias("url"), F.concat(F.lit("<title>T"), "id", F.lit("</title><p>d")).alias("html"))
    rows = llms.page_rows(pages)
    compose(llms.render_rows(rows), str(tmp_path / "r.txt"))
    assert (tmp_path / "r.txt").read_text() == llms.render(rows).first()["report"]


def test_a_file_is_replaced_when_whole(spark, tmp_path):
    to = tmp_path / "f"
    to.write_text("old")
    bad = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="no"):
        compose(bad, str(to))
    assert to.read_text() == "old"
    assert compose(spark.range(3).select(F.lit("n").alias("text")), to.as_uri()) == 3 and Path(to).read_text() == "nnn"
