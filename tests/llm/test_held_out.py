"""A language with no held-out trusted documents keeps clean documents under the model of words."""

from folio.llm import kneser_ney


def test_thresholds_in_words_never_come_from_counted_texts(spark):
    import numpy as np

    text = lambda i: " ".join(np.random.default_rng(i).choice([f"w{k}" for k in range(300)], 80))
    counted = spark.range(400).where("pmod(xxhash64(id), 5) <> 0").limit(30).collect()
    trusted = [r[0] for r in counted]
    rows = [(i, text(i), "en") for i in trusted] + [(1000 + i, text(1000 + i), "en") for i in range(40)]
    got = kneser_ney.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i,) for i in trusted], "doc_id long"))
    assert got.where("doc_id >= 1000 AND kept").count() >= 30
