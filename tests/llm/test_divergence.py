"""The source audit against its SQL and, with small limits, against a plain count in Python."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from folio.llm import divergence
from folio.llm.queries import QUERIES, SQL

NAME, SCHEMA = "op12_source_divergence", "doc_id long, text string, lang string, source string, term string, n int"


def same_as_sql(spark, folder, files):
    df = QUERIES[NAME](spark, str(folder))
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        want = duck.execute(SQL[NAME]).fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(want)
    return got


def test_smallest_tables(spark, sf_dir):
    assert len(same_as_sql(spark, sf_dir, f"{sf_dir}/documents.parquet")) > 1_000


def brute(rows, least=3, ranks=200):
    docs = [(x or "", s or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for t, x, s in rows]
    held, n, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, ws in docs:
        held[lang].update(set(ws))
        n[lang, source].update(ws)
        whole[lang].update(ws)
    out = []
    for lang, source in n:
        kept = [t for t, k in held[lang].items() if k >= least]
        p = lambda c, kept=kept: (lambda total: {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept})(sum(c[t] for t in kept))
        f = lambda a, b: (a - b) ** 2 // b
        own = p(n[lang, source])
        pairs = [(o, sum(f(own[t], q) for t, q in p(n[lang, o]).items())) for x, o in n if x == lang and o != source]
        terms = [(t, f(own[t], q)) for t, q in p(whole[lang]).items() if n[lang, source][t] and own[t] > q]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(ordered, 1)]
    return out


AWKWARD = [
    *[("Alpha beta ÄRGER a1b2 naïve", "de", "s1")] * 3, ("alpha ALPHA beta", "de", "s2"), ("Straße 漢字 alpha", "de", None), (None, "de", "s4"), ("", "de", "s5"),
    ("\x00nul\x00 alpha\x7fbeta [x]{y}`z", "de", "s2"), ("only here", "fr", "s1"), (None, "fr", "s2"), ("alpha " * 3_000, "en", "s1"), ("alpha", "en", "s1"), ("beta alpha", "en", "s2"), ("x beta", "en", "s2"), ("X beta é", "en", ""),
    ("x é", None, None), ("x é", "", "s9"), (" x é ", None, "s9"), ("lone", "xx", "one"), ("z" * 300_000 + " q", "en", "s3"),
]


@pytest.mark.parametrize("rows", [AWKWARD, AWKWARD * 2, [], [(None, None, None)]])
def test_awkward_rows(spark, tmp_path, rows):
    spark.createDataFrame([(i // 2, t, x, s, "clash", 1) for i, (t, x, s) in enumerate(rows)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = same_as_sql(spark, tmp_path, f"{tmp_path}/documents.parquet/*.parquet")
    assert sorted(got) == sorted(brute(rows))


def test_other_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(" ".join(f"w{chr(97 + int(w))}" for w in rng.zipf(1.3, 30) % 26), f"l{i % 2}", f"s{i % 7}") for i in range(200)]
    df = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(5), least_docs=9, ranks=3)
    assert sorted(tuple(r) for r in df.collect()) == sorted(brute(rows, 9, 3))


def test_gathered_counts_are_folded(monkeypatch):
    """Counts that are given away early still add up."""
    monkeypatch.setattr(divergence, "GATHERED", 40)
    monkeypatch.setattr(divergence, "PIECE", 64)
    texts = [f"{chr(97 + i % 26)}{chr(97 + i % 23)} the {'word ' * (i % 5)}" for i in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 100), pa.array(["s"] * 100), pa.array(texts[a : a + 100])], names=["lang", "source", "text"]) for a in range(0, 400, 100)]
    n, docs = Counter(), Counter()
    for b in divergence._count(iter(batches)):
        for r in b.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert n == Counter(w for t in texts for w in t.split()) and docs == Counter(w for t in texts for w in set(t.split()))


def test_terms_do_not_cross_rows():
    row, term = divergence.terms(pa.array(["ab", "cd", "", "1", "Éf g", "", ""])[1:])
    assert list(zip(row.tolist(), term.to_pylist(), strict=True)) == [(0, "cd"), (3, "Éf"), (3, "g")]
    assert divergence.terms(pa.array([], pa.string()))[1].to_pylist() == []
