"""The rollup query applies all three kinds of changes to the whole table and ends with its plain totals."""

import collections

from folio.llm import queries, rollup


def test_all_kinds_over_the_whole_table(spark, sf_dir, monkeypatch):
    kinds, signed = collections.Counter(), rollup.signed_rows

    def counting(changes):
        kinds.update({r["op"]: r["count"] for r in changes.groupBy("op").count().collect()})
        return signed(changes)

    monkeypatch.setattr(rollup, "signed_rows", counting)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in queries.op7_token_rollup(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = 2 * docs.count()
    assert kinds["revise"] == kinds["delete"] == rows and kinds["insert"] >= 2 * rows
    want = collections.defaultdict(lambda: (0, 0))
    for r in rollup.token_counts(docs).unionByName(rollup.token_counts(docs, "words", "words-1")).collect():
        d, t = want[k := (r["source"], r["lang"], r["tokenizer"])]
        want[k] = (d + 1, t + r["tokens"])
    assert got == dict(want)
