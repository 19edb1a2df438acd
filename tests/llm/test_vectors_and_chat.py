import json

import numpy as np
import pytest

from folio.llm import chat, vectors
from folio.llm.components import components
from folio.llm.queries import TOOLS, tool_events
from folio.llm.scratch import Scratch


# -- components -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)]
    up = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "c")).collect()}
    assert got == {x: c for x, c in up.items() if any(x in e and e[0] != e[1] for e in edges)}


# -- vectors ----------------------------------------------------------------------------------------------------------------------
def awkward(dim=16):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(6):
        base = rng.standard_normal(dim)
        rows += [(base + rng.standard_normal(dim) * s).tolist() for s in (0, 0.05, 0.1, 0.15, 0.2)]
    rows += [rng.standard_normal(dim).tolist() for _ in range(60)]
    rows += [rows[0], [2 * x for x in rows[0]], [-x for x in rows[0]], None, [], [0.0] * dim, [float("nan")] * dim, [float("inf"), *[0.0] * (dim - 1)], [None, *[1.0] * (dim - 1)], [1.0, 0.0], [1.0, 0.01]]
    ids = [*range(len(rows) - 1), None]
    return [(i, v, 1, 9) for i, v in zip(ids, rows, strict=True)] + [(3, rows[3], 0, 9)]


def brute_vectors(rows, t=0.95):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.sqrt((x * x).sum())

    us = [unit(v) for _, v, *_ in rows]
    n = len(rows)
    link = [[i != j and us[i] is not None and us[j] is not None and len(us[i]) == len(us[j]) and (us[i] * us[j]).sum() >= t for j in range(n)] for i in range(n)]
    lab = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    lab[i] = lab[j] = min(lab[i], lab[j])
    least = {}
    for (d, *_), c in zip(rows, lab, strict=True):
        least.setdefault(c, []).append(d)
    comp = [min((x for x in least[c] if x is not None), default=None) for c in lab]
    return [(r[0], sum(link[i]), comp[i], r[0] == comp[i]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("kind", "options"), [("float", {}), ("double", {"block_dims": 5}), ("double", {"chunk": 7, "block_dims": 8}), ("float", {"chunk": 1})])
def test_near_vectors(spark, kind, options):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], a, b) for i, v, a, b in awkward()]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, weight int")
    got = [tuple(r) for r in vectors.near_dedup(df, **options).collect()]
    assert sorted(got, key=str) == sorted(brute_vectors(rows), key=str)


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    rows = [(i, (base * f + 0).tolist()) for i, f in enumerate((1e300, 1e200, 1.0, 1e-200, 5e-300))] + [(9, rng.standard_normal(16).tolist())]
    got = vectors.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, 4, 0) for i in range(5)] + [(9, 0, 9)]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_dedup(df).count() == 0
    assert vectors.near_dedup(spark.createDataFrame([(1, None)], df.schema)).first() == (1, 0, 1, True)


def test_budget_covers_the_threshold():
    u, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((16, 16)))
    a, c = u[0], 0.95
    b = c * a + np.sqrt(1 - c * c) * u[1]
    z = (a - b) @ vectors.rotation(16)
    assert any((z[s] ** 2).sum() <= m for s, m in zip(vectors.splits(16, 5), vectors.budgets(16, 5, c), strict=True))


def test_links_of_a_dense_cell_come_in_batches():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(16) + rng.standard_normal((1500, 16)) * 1e-3
    batches = [(len(a), len(b)) for k in range(2) for a, b in vectors.links_of(x, k, 8, 0.95, np.zeros(1500, np.int8))]
    assert sum(n for n, _ in batches) == 1500 * 1499 // 2
    assert max(n for n, _ in batches) <= 1 << 16


@pytest.mark.parametrize("seed", range(4))
def test_hooking_batches_of_links(seed):
    rng = np.random.default_rng(seed)
    links, root = rng.integers(0, 300, (220, 2)), np.arange(300)
    for part in np.array_split(links, 7):
        root = vectors.hook(root, part[:, 0], part[:, 1])
    least = list(range(300))
    for _ in range(300):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert root.tolist() == least


# -- chat -------------------------------------------------------------------------------------------------------------------------
EVENTS = "conv_id long, turn long, kind string, role string, content string, call_id string, tool string, arguments string, depends array<string>, level string"


def events(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], EVENTS)


def test_links_and_order(spark):
    ok = '{"query": "q", "step": 1, "limit": 2}'
    rows = [
        (1, 0, "message", " User ", "hi", None, None, None, None),
        (1, 1, "result", "tool", "early", "a", None, None, None),
        (1, 2, "call", "assistant", None, "a", "lookup", ok, ["b"]),
        (1, 3, "call", "assistant", None, "b", "lookup", ok, None),
        (1, 4, "result", "tool", "late", "b", None, None, None),
        (1, 5, "call", "assistant", None, "c", "lookup", ok, ["d"]),
        (1, 6, "call", "assistant", None, "d", "lookup", ok, ["c", "gone"]),
        (1, 7, "call", "assistant", None, "e", "lookup", ok, ["d"]),
        (1, 8, "result", "tool", None, "zz", None, None, None),
        (1, 9, "call", "assistant", None, "b", "lookup", "{}", None),
        (1, 10, "call", "assistant", None, None, "lookup", ok, None),
        (None, 0, "call", "assistant", None, "a", "lookup", ok, None),
        (None, None, "result", "tool", "r", "a", None, None, None),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_tool_calls(events(spark, *rows), TOOLS).collect()}
    link = {k: r["link"] for k, r in got.items()}
    assert [link[1, t] for t in range(11)] == [None, "linked", "linked", "linked", "linked", "cyclic", "cyclic", "cyclic", "orphan", "duplicate", "unanswered"]
    assert (link[None, 0], link[None, None]) == ("linked", "linked")
    assert [(got[1, t]["after"], got[1, t]["level"]) for t in (3, 4, 2, 1)] == [(3, 0), (4, 1), (4, 2), (4, 3)]
    assert got[1, 5]["level"] is None and got[1, 5]["after"] == 5
    order = sorted((r["after"], r["level"], r["turn"]) for k, r in got.items() if k[0] == 1 and r["level"] is not None)
    turns = [t for _, _, t in order]
    assert turns.index(3) < turns.index(4) < turns.index(2) < turns.index(1)
    assert chat.link_tool_calls(events(spark), TOOLS).count() == 0


@pytest.mark.parametrize(
    ("tool", "arguments", "problems"),
    [
        ("lookup", '{"query":"q","step":1,"limit":2}', ""),
        ("lookup", '{"query":"q","step":1,"limit":9}', "limit: too large"),
        ("lookup", '{"query":"q","step":"1","limit":-1}', "limit: too small; step: not integer"),
        ("lookup", '{"step":1,"limit":0,"b":1,"a":2}', "query: missing; unknown: a,b"),
        ("rewrite", '{"query":"q","style":"odd","more":[1]}', "style: not allowed"),
        ("other", "{}", "tool: unknown"),
        (None, "{}", "tool: unknown"),
        ("lookup", "[1]", "arguments: not an object"),
        ("lookup", "{broken", "arguments: not an object"),
        ("lookup", '{"query":"q","query":"r","step":1,"limit":2}', "arguments: not an object"),
        ("lookup", None, "arguments: not an object"),
    ],
)
def test_validation(spark, tool, arguments, problems):
    row = chat.link_tool_calls(events(spark, (1, 0, "call", "assistant", None, "a", tool, arguments, None)), TOOLS).first()
    assert (row["problems"], row["valid"]) == (problems, problems == "")


@pytest.mark.parametrize("seed", range(2))
def test_levels_of_chains_trees_and_cycles(spark, seed):
    """A chain of 100 calls, a random graph with cycles, and results that come late, against the definition."""
    rng = np.random.default_rng(seed)
    needs = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(100)}
    needs |= {f"r{k}": [f"r{j}" for j in rng.choice(40, rng.integers(0, 3), replace=False) if rng.random() < 0.15 or j < k] for k in range(40)}
    needs |= {"r0": ["c99"], "top": ["r5", "c50", "gone"], "self": ["self"], "behind": ["self", "c3"], "tail": ["behind"]}
    names = list(needs)
    turn = {n: int(t) for n, t in zip(names, rng.permutation(len(names)), strict=True)}
    late = {n: 1000 + k for k, n in enumerate(names) if rng.random() < 0.3}
    rows = [(7, turn[n], "call", "assistant", None, n, "lookup", "{}", needs[n]) for n in names] + [(7, t, "result", "tool", "r", n, None, None, None) for n, t in late.items()]

    def walk(n, path=()):
        """Greatest turn and longest chain below, None on or behind a cycle."""
        if n in path:
            return None
        after, level = turn[n], 0
        for d in needs[n]:
            if d in needs:
                below = walk(d, (*path, n))
                if below is None:
                    return None
                after, level = max(after, below[0], late.get(d, -1)), max(level, below[1] + 2)
        return after, level

    got = {r["call_id"]: r for r in chat.link_tool_calls(events(spark, *rows), TOOLS).where("kind = 'call'").collect()}
    import sys

    sys.setrecursionlimit(10_000)
    for n in names:
        want = walk(n)
        assert ((got[n]["after"], got[n]["level"]) if got[n]["link"] != "cyclic" else None) == want, n


DEEP = {
    "t": {
        "properties": {
            "flag": {"type": "boolean", "enum": [True]},
            "mode": {"enum": [1, "1", None]},
            "place": {"type": "object", "properties": {"lat": {"type": "number", "minimum": -90}, "name": {"type": "string"}}, "required": ["lat"], "additional": False},
            "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}},
        }
    }
}


@pytest.mark.parametrize(
    ("arguments", "problems"),
    [
        ("{}", ""),
        ('{"flag":true,"mode":1.0,"place":{"lat":1,"name":"x"},"tags":["a","b"]}', ""),
        ('{"flag":false,"mode":"1","tags":[]}', "flag: not allowed"),
        ('{"flag":"true","mode":2,"place":{}}', "flag: not boolean; flag: not allowed; mode: not allowed; place.lat: missing"),
        ('{"place":{"lat":-91,"name":3,"q":1},"tags":["a","c"]}', "place.lat: too small; place.name: not string; place: unknown: q; tags: wrong items"),
        ('{"place":[],"tags":"a","mode":null}', "place: not object; tags: not array"),
    ],
)
def test_nested_schemas(spark, arguments, problems):
    assert chat.link_tool_calls(events(spark, (1, 0, "call", "assistant", None, "a", "t", arguments, None)), DEEP).first()["problems"] == problems


def test_whole_numbers_and_null_content(spark):
    rows = [(1, 0, "call", "assistant", None, "a", "lookup", '{"query":"q","step":1.0,"limit":2}', None), (1, 1, "result", "tool", None, "a", None, None, None), (1, 2, "message", None, None, None, None, None, None)]
    got = {r["turn"]: r for r in chat.link_tool_calls(events(spark, *rows), TOOLS).collect()}
    assert got[0]["valid"] and json.loads(got[0]["json"])["tool_calls"][0]["arguments"]["step"] == 1
    assert got[1]["json"] == '{"content":null,"role":"tool","tool_call_id":"a"}' and got[2]["json"] == '{"content":null,"role":null}'


def test_canonical_json(spark):
    text = '{ "b" : [1, {"z": 1, "a": "é\\n\\"/"}], "a": {"y": null, "x": true} }'
    row = chat.link_tool_calls(events(spark, (1, 0, "call", "assistant", None, "i", "t", text, None)), {}).first()
    want = {"role": "assistant", "tool_calls": [{"arguments": json.loads(text), "id": "i", "name": "t"}]}
    assert row["json"] == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_conversations_view(spark, sf_dir):
    plain = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = chat.link_tool_calls(tool_events(plain), TOOLS).collect()
    source = {(r["conv_id"], r["turn"]): r for r in plain.collect()}
    assert len(rows) == len(source)
    for r in rows:
        own, json_ = source[r["conv_id"], r["turn"]], json.loads(r["json"])
        assert json.dumps(json_, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]
        if own["role"] == "user":
            size, (call,) = len(own["text"].encode()), json_["tool_calls"]
            assert call["arguments"]["query"] == own["text"]
            assert r["valid"] == ((size % 5 > 0) if call["name"] == "rewrite" else size % 7 <= 5)
            reply = source.get((r["conv_id"], r["turn"] + 1))
            assert r["link"] == ("linked" if reply and reply["role"] == "assistant" else "unanswered")


# -- vectors at size --------------------------------------------------------------------------------------------------------------
def test_half_of_the_coordinates_leaves_few_candidates_and_every_link():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    x[1::10] = x[::10] + rng.standard_normal((300, 64)) * 0.25  # about the threshold
    side = vectors.Side(x, 0, 64, 0.95)
    u = vectors.unit(x)[side.order]
    links = np.triu(u @ u.T >= 0.95, 1)
    least = -side.limits[0] / 2 - vectors.ROUNDING * (side.left.shape[1] + 8)
    near = np.triu(side.left @ side.right.T >= least, 1)
    assert 50 < links.sum() < 300 and not (links & ~near).any()
    assert near.sum() < 400  # of 4.5 million pairs
    got = {tuple(sorted(map(int, p))) for a, b in vectors.links_between(side, side, 0, 0.95) for p in zip(a, b, strict=True)}
    assert got == {tuple(sorted(map(int, side.order[list(p)]))) for p in zip(*np.nonzero(links), strict=True)}


def test_a_vector_lies_in_one_chunk(spark):
    """However many chunks it meets, it is written once; before, it was sent to two groups of every block and to each pair of chunks there."""
    from pathlib import Path
    from urllib.parse import urlparse

    from folio.llm.scratch import Scratch

    rng, scratch = np.random.default_rng(6), Scratch(spark, "one_chunk")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 8)))], "vec_id long, embedding array<double>")
    vectors.near_dedup(df, chunk=10, scratch=scratch).collect()
    nodes = []
    for f in Path(urlparse(scratch.path("chunks")).path).iterdir():
        data = f.read_bytes()
        nodes += np.frombuffer(data, "<i8", int.from_bytes(data[:8], "little"), 8).tolist()
    assert len(nodes) == len(set(nodes)) == 60
