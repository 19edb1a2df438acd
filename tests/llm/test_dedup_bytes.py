"""Texts with one key and other bytes are no duplicates."""

import collections

import pytest
from pyspark.sql import functions as F

from folio.llm import dedup


@pytest.mark.parametrize("batches", [2, 3])
def test_a_digest_in_common_is_no_duplicate(spark, monkeypatch, batches):
    digested = dedup._digested
    one = lambda *a: digested(*a).withColumns({"digest": F.unhex(F.lit("ab")), "check": F.lit(7).cast("long")})
    monkeypatch.setattr(dedup, "_digested", one)
    ids = collections.defaultdict(list)
    for i, b in spark.range(200).select("id", F.pmod(F.xxhash64("id"), F.lit(batches))).collect():
        ids[b].append(i)
    texts = {0: "aa", 1: "bb", 2: "bb"}  # one text a batch, as those of one batch meet by digest; the third batch has the text of the second
    rows = [(i, texts[b]) for b in range(batches) for i in ids[b][:5]] + [(i, "longer") for b in range(batches) for i in ids[b][5:7]]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == sorted((i, min(groups[t]), len(groups[t])) for i, t in rows)
