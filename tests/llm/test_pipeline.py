"""The stages of the pipeline and their chain against brute force on a small fixture."""

import collections
import itertools
import math
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_text_operators import brute_words, ids_of, norm, shingles  # noqa: E402


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice([f"{x}{y}" for x in "the of and to in is".split() for y in ("", "s", "ing", "ed")], n, p=np.arange(24, 0, -1) / 300))


def table():
    """Trusted and other prose in two languages, exact copies with other blanks, near copies, junk, empty texts and a null id."""
    rows = [(i, prose(i, 60 + i % 7), "en" if i % 3 else "de", f"s{i % 4}") for i in range(90)]
    rows += [(200 + i, re.sub(" ", "  ", rows[i][1], count=3), rows[i][2], "s1") for i in range(0, 20, 2)]
    for i in range(20, 30):
        w = rows[i][1].split()
        w[30] = f"of{i}"
        rows.append((300 + i, " ".join(w), rows[i][2], "s2"))
    rng = np.random.default_rng(1)
    rows += [(400 + i, " ".join("".join(rng.choice(list("qxzjvkw#%"), 7)) for _ in range(50)), "en", "s3") for i in range(6)]
    rows += [(500, None, "en", "s0"), (501, "", "de", None), (None, prose(700, 50), "en", None), (502, prose(701, 4), "de", "s0"), (502, prose(701, 4), "de", "s0")]
    return [(*r, len(r[1] or ""), "kept") for r in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(table(), "doc_id long, text string, lang string, source string, n_chars long, level string").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 90, 1) if i % 5 != 4] + [(400, 0, 0), (1, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def expected(spark, docs, trusted):
    """What the first four stages keep, stage by stage, by brute force."""
    held = {r[0] for r in spark.createDataFrame([(i,) for i in trusted], "doc_id long").where("pmod(xxhash64(doc_id), 5) = 0").collect()}
    logs = {k: brute_words([t for d, t, lang, *_ in docs if lang == k and d in trusted - held]) for k in ("en", "de")}
    ppl = lambda t, k: (lambda x: (math.exp(-sum(x) / len(x)), -sum(x), len(x)))(logs[k](t))
    good = collections.defaultdict(list)
    for d, t, lang, *_ in docs:
        if d in held and t:
            good[lang].append(ppl(t, lang))
    low = lambda xs, q: sorted(xs)[max(math.ceil(q * len(xs)) - 1, 0)]
    typical = {k: low([p for p, *_ in v], 0.5) for k, v in good.items()}
    level = lambda s, n, k: math.exp((s + 40 * math.log(typical[k])) / (n + 40))
    far = {k: [math.log(level(s, n, k) / typical[k]) for _, s, n in v] for k, v in good.items()}
    both = low([x for v in far.values() for x in v], 0.985)
    limit = {k: typical[k] * 1.05 * math.exp((len(v) * low(v, 0.985) + 20 * both) / (len(v) + 20)) for k, v in far.items()}
    kept = [r for r in docs if r[1] and (lambda x: level(x[1], x[2], r[2]) <= limit[r[2]])(ppl(r[1], r[2]))]
    key = lambda r: (r[0] is None, r[0])
    one = {}
    for r in sorted(kept, key=key):
        one.setdefault(norm(r[1]), r)
    unique = list(one.values())
    sets, up = [shingles(r[1]) for r in unique], list(range(len(unique)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in itertools.combinations(range(len(unique)), 2):
        if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            up[max(root(x), root(y))] = min(root(x), root(y))
    return kept, unique, [r for i, r in enumerate(unique) if up[i] == i]


def test_stages(spark, sf):
    docs, done = spark.read.parquet(f"{sf}/documents.parquet"), {}
    rows = [tuple(r) for r in docs.collect()]
    trusted = {i for i in range(90) if i % 5 != 4}
    kept, unique, apart = expected(spark, rows, trusted)
    assert 6 <= len(rows) - len(kept) < 20 and len(kept) > len(unique) > len(apart)
    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, [kept, unique, apart, None, None], strict=True):
        now = stage(spark, now, sf)
        got = [tuple(r) for r in now.collect()]
        done[name] = got
        if want is not None:
            assert now.columns == docs.columns and sorted(got, key=str) == sorted(want, key=str), name
    mixed, ids = done["mix_sources"], dict(zip([r[1] for r in apart], ids_of([r[1] for r in apart]), strict=True))
    size = lambda r: len(r[1].split())
    assert set(mixed) <= set(apart) and max(collections.Counter(mixed).values()) <= 3
    names = sorted({r[3] for r in apart if r[3]}) + [None] * any(r[3] is None for r in apart)
    total, own = sum(map(size, apart)), {s: sum(size(r) for r in apart if r[3] == s) for s in names}
    weight, target, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set()
    while True:
        rest = total - sum(3 * own[s] for s in full)
        target = {s: 3 * own[s] if s in full else rest * weight[s] / sum(weight[t] for t in names if t not in full) for s in names}
        over = {s for s in names if target[s] > 3 * own[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert abs(sum(size(r) for r in mixed if r[3] == s) - target[s]) <= max(size(r) for r in apart if r[3] == s) / 2 + 1e-6
    pieces = collections.Counter()
    for p in now.collect():
        assert p["length"] & (p["length"] - 1) == 0 and len(p["ids"]) == 4 * p["length"]
        pieces[p["doc_id"]] += p["length"]
    assert pieces == sum((collections.Counter({r[0]: len(ids[r[1]])}) for r in mixed), collections.Counter())


def test_run_is_the_chain(spark, sf):
    one, two = corpus_pipeline.run(spark, sf).drop("sequence_id"), corpus_pipeline.run(spark, sf).drop("sequence_id")
    assert one.count() > 0 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0 and docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
