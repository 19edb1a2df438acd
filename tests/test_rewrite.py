"""Links replaced in one pass are what replacing them one after another gives."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folio.operators import images

PIECES = ["![a](x)", "![a](y)", "![b](x)", "![](x(1))", "![a", "](x)", "![", "[a](x)", "!", " ", "text", "![a ![b](x)", "![a]", "(x)", "\n", "é", ")", "![a](xx)"]
NEWS = ["![a](z)", "![a](x)", "![b](x)", "![q ![a](x)](w)", "", "plain", "![a](x)tail", "![", "[a](x)", "![n](p(1).png)", "![a](x(2))"]


def one_by_one(text, pairs):
    for _, old, new in sorted(pairs):
        text = text.replace(old, new, 1)
    return text


@pytest.mark.parametrize("pattern", [images.REFERENCE, images.EXPORT_REFERENCE])
def test_as_one_after_another(spark, pattern):
    rng = random.Random(5)
    found = re.compile(pattern.removeprefix("(?d)"))
    docs, pairs = [], []
    for k in range(1_500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        refs = [m.group() for m in found.finditer(text)]
        plain = k % 2 == 0  # one new text for each old one, as commands make them
        new = {r: rng.choice(NEWS[:1] + NEWS[-2:]) if plain else None for r in refs}
        own = [(pos, r, new[r] if plain else rng.choice(NEWS)) for pos, r in enumerate(refs) if (len(r) + k) % 3 or (not plain and rng.random() < 0.5)]
        if not plain and rng.random() < 0.2:
            own.append((rng.randrange(5), rng.choice(PIECES), rng.choice(NEWS)))
        docs.append((k, text))
        pairs += [(k, *p) for p in own if p[1]]
    df = spark.createDataFrame(docs, "doc_id long, content string")
    got = images.rewrite(df, spark.createDataFrame(pairs, "doc_id long, pos int, old string, new string"), pattern=pattern)
    want = {k: one_by_one(t, [p[1:] for p in pairs if p[0] == k]) for k, t in docs}
    assert {r["doc_id"]: r["content"] for r in got.collect()} == want


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, "![a](x)", "p"), (1, "![a](x)![a](x)", "q"), (None, "![a](x)", "r"), (2, None, "s"), (3, "", "t"), (4, "no link", "u")], "doc_id long, content string, pairs string")
    new = spark.createDataFrame([(1, 0, "![a](x)", "![a](y)"), (2, 0, "![a](x)", "z"), (3, 0, "![a](x)", "z"), (None, 0, "![a](x)", "z"), (4, 0, "no", "yes")], "doc_id long, pos int, old string, new string")
    got = images.rewrite(df, new)
    assert got.columns == ["doc_id", "content", "pairs"]
    assert {r["pairs"]: r["content"] for r in got.collect()} == {"p": "![a](y)", "q": "![a](y)![a](x)", "r": "![a](x)", "s": None, "t": "", "u": "yes link"}


def test_many_links_in_linear_time(spark):
    took = []
    for n in (2_000, 2_000, 20_000):
        text = "".join(f"some words ![alt {i}](https://host/path/{i}.png)\n" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, content string")
        refs = images.references(df, "doc_id")
        new = refs.select("doc_id", "pos", F.col("full_match").alias("old"), F.concat(F.lit("![x]("), "pos", F.lit(")")).alias("new"))
        began = time.time()
        got = images.rewrite(df, new).first()["content"]
        took.append(time.time() - began)
        assert got == "".join(f"some words ![x]({i})\n" for i in range(n))
    assert took[2] < 10 * took[1] + 10
