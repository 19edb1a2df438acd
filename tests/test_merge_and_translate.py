import itertools
import json

import pytest
from pyspark.sql import functions as F

from folio.operators import merge, translate
from folio.sources import config, files, nav, pandoc


def shifted(spark, texts, by):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    return [r["content"] for r in merge.shift_headings(df, by).orderBy("i").collect()]


def test_shift_cases(spark):
    assert shifted(spark, ["a\n---\n---", "\n===\n---", "# T\n---", "", "a\r\n# b\r\n"], 1) == ["### a", "\n### ===", "### # T", "", "a\n## b"]
    assert shifted(spark, ["## x", "# x", "x\n="], 5) == ["**x**", "###### x", "###### x"]
    assert shifted(spark, ["# x"], -1) == [" x"]
    assert shifted(spark, ["# x"], 0) == ["# x"]


def model(text, by):
    """Line by line, the previous line carried along."""
    import re

    ls = text.split("\n")
    out, prev = [], ""
    for s in ls[:-1] if ls[-1] == "" else ls:
        atx, under = re.fullmatch(r"(#{1,6})[\t\n\f\r ]+(.+)", s), re.fullmatch(r"(=+|-+)[\t\n\f\r ]*", s)
        put = lambda n, t: "#" * n + " " + t if n <= 6 else f"**{t}**"
        if atx:
            out.append(put(len(atx[1]) + by, atx[2]))
        elif under and prev:
            out[-1] = put((1 if s[0] == "=" else 2) + by, prev)
            continue
        else:
            out.append(s)
        prev = s
    return "\n".join(out)


@pytest.mark.parametrize("by", [1, 5])
def test_shift_of_all_short_documents(spark, by):
    texts = ["\n".join(p) for n in (1, 2, 3, 4) for p in itertools.product(["a", "", "===", "---", "# h"], repeat=n)]
    assert shifted(spark, texts, by) == [model(t, by) for t in texts]


def test_sanitise(spark):
    cases = {"-a:b": ("-a: b", "- a: b"), "---": ("- --", "- --"), "see http://x.io": ("see http: //x.io",) * 2, "a: b:c": ("a: b:c",) * 2, "    k:v": ("    k:v",) * 2, "-": ("-",) * 2, "- x": ("- x",) * 2}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i")
    rows = df.select(merge.sanitise(F.col("c")), merge.sanitise(F.col("c"), 2)).collect()
    assert [tuple(r) for r in rows] == list(cases.values())


def test_merge(spark):
    df = spark.createDataFrame([(2, "b_x.md", "# B\n"), (1, "a.md", "---\nt: 1\n---\n# A\ntext")], "ord int, path string, content string")
    assert merge.merge(df, 1, True).first()["merged"] == "## A\n\n## A\ntext\n\n## B X\n\n## B"
    assert merge.merge(df).first()["merged"] == "# A\ntext\n\n# B\n"
    for options in ((0, False), (1, True)):
        assert "\n\n".join(r["text"] for r in merge.merge_rows(df, *options).collect()) == merge.merge(df, *options).first()["merged"]
    assert merge.add_title(spark.createDataFrame([("my_doc-one.md", "c")], "path string, content string")).first()["content"] == "# My Doc One\n\nc"
    assert [r["dir"] for r in merge.source_dirs(df.withColumn("path", F.concat(F.lit("d"), "ord", F.lit("/a")))).orderBy("first_ord").collect()] == ["d1", "d2"]


def test_front_matter(spark):
    df = spark.createDataFrame([(0, "---\na: 1\n---\nbody"), (1, "---\n---\nbody"), (2, "none")], "i int, c string").orderBy("i")
    assert [tuple(r[0]) for r in df.select(translate.front_matter(F.col("c"))).collect()] == [("a: 1", "body"), (None, "---\n---\nbody"), (None, "none")]
    two = spark.createDataFrame([(0, "--- x --- y --- z"), (1, "---\nonly")], "i int, c string").orderBy("i")
    assert [r[0] for r in two.select(translate.second_removal(F.col("c"))).collect()] == ["y --- z", "---\nonly"]


def test_translate(spark):
    docs = spark.createDataFrame([("/d/a.md", "---\nb: 1\na: x\n---\nHello"), ("/d/b.md", "B"), ("/d/c.md", "fail")], "path string, content string")
    targets = spark.createDataFrame([("/d/b_zh.md", "---\ntranslated: true\n---\nold"), ("/d/a_zh.md", "---\ntranslated: yes please\n---\nold")], "path string, content string")

    def client(body):
        said = json.loads(body)
        text = said["messages"][1]["content"]
        if text == "fail":
            return json.dumps({"choices": []})
        assert said["messages"][0]["content"] == "to zh {TARGET_LANG}" and said["model"] == "m"
        return json.dumps({"choices": [{"message": {"role": "assistant", "content": f"<think>x\ny</think>\n\n{text}!"}}]})

    rows = {r["path"]: r for r in translate.translate(docs, targets, "zh", client, "to {TARGET_LANG} {TARGET_LANG}", "m").collect()}
    assert set(rows) == {"/d/a.md", "/d/c.md"}
    assert rows["/d/a.md"]["output"] == "---\na: x\nb: 1\ntranslated: true\n---\n\nHello!" and rows["/d/a.md"]["target"] == "/d/a_zh.md"
    assert rows["/d/c.md"]["output"] is None and rows["/d/c.md"]["error"] == "no translation result"
    assert translate.pending(docs, targets, "zh", force=True).count() == 3
    with pytest.raises(ValueError, match="not supported"):
        translate.translate(docs, targets, "xx", client, "", "m")
    assert translate.listing().startswith("ar (")
    ks = translate.progress(docs.select("path")).orderBy("path").collect()
    assert [(r["k"], r["n"]) for r in ks] == [(1, 3), (2, 3), (3, 3)]


def test_navigation(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for n in ("a.md", "b.md", "c.md"):
        (docs / n).write_text(n)
    (tmp_path / "base.yml").write_text("nav:\n  - gone.md\nsite_name: base\n")
    (tmp_path / "mkdocs.yml").write_text("INHERIT: base.yml\nnav:\n  - a.md\n  - Part:\n      - One: b.md\n      - Two: missing.md\n      - c.md\n")
    rows = [(tuple(r["title_path"]), r["file"].rsplit("/", 1)[1]) for r in nav.read_nav(spark, str(tmp_path)).orderBy("ord").collect()]
    assert rows == [((), "a.md"), (("Part", "One"), "b.md"), (("Part",), "c.md")]
    assert [r["file"][-4:] for r in nav.read_nav(spark, str(tmp_path), "Part/One").collect()] == ["b.md"]
    assert nav.read_config(tmp_path / "mkdocs.yml")["site_name"] == "base"
    (tmp_path / "base.yml").write_text("INHERIT: mkdocs.yml\n")
    with pytest.raises(ValueError, match="inherit from each other"):
        nav.read_config(tmp_path / "mkdocs.yml")
    for kind, error in (("hugo", NotImplementedError), ("x", ValueError)):
        with pytest.raises(error):
            nav.site_files(spark, kind, str(tmp_path))


def test_files_and_export(spark, tmp_path):
    from folio.plans.commands import export

    (tmp_path / "x").mkdir()
    (tmp_path / "b.MD").write_bytes("中文".encode("gbk"))
    (tmp_path / "x/a.markdown").write_text("# A\n![i](i.png)\n")
    (tmp_path / "x/i.png").write_bytes(b"1")
    (tmp_path / "n.txt").write_text("no")
    assert sorted(r["path"][-4:] for r in files.scan(spark, str(tmp_path), "lint").collect()) == ["b.MD", "down"]
    assert [r["path"][-4:] for r in files.scan(spark, str(tmp_path), "upload").collect()] == ["down"]
    with pytest.raises(ValueError, match=r"\.\."):
        files.scan_globs(spark, ["../a.md"])
    got, warnings = files.scan_globs(spark, [str(tmp_path / "*.MD"), str(tmp_path / "none.md")])
    assert got.count() == 1 and len(warnings) == 1
    out = export(spark, str(tmp_path), "/o/out.pdf", str(tmp_path), pandoc.ExportOptions(format="pdf", toc=True, shift=1))
    assert out.merged.first()["merged"] == "中文\n\n## A\n![i](x/i.png)"
    assert out.arguments[-6:] == ["-V", "CJKmainfont=SimSun", "-V", "documentclass=article", "-V", "geometry=margin=1in"]
    assert "--toc-depth" in out.arguments and out.arguments.count("--resource-path") == 3
    texts = spark.createDataFrame([(f"{tmp_path}/out/t.md", "é\n")], "target string, output string")
    assert files.write_texts(texts).first()["error"] is None
    assert (tmp_path / "out/t.md").read_text() == "é\n"
    with pytest.raises(FileNotFoundError):
        export(spark, str(tmp_path / "out2"), "o", "w") if (tmp_path / "out2").mkdir() is None else None


def test_config(tmp_path):
    path = tmp_path / "c/config.json"
    cfg, error = config.load(path)
    assert error is None and path.exists() and cfg.model == config.MODEL
    cfg = cfg.set("api_key", "k").set("temperature", "0.5").set("cloud_storages.a.access_key", "s").set("cloud_storages.a.concurrency", "7")
    assert cfg.default_storage == "a" and cfg.get("cloud_storages.a.concurrency") == 7 and cfg.shown()["api_key"] == "***"
    config.save(cfg, path)
    assert config.load(path)[0] == cfg
    for key, value in (("nope", "1"), ("cloud_storages.a.nope", "1")):
        with pytest.raises(KeyError):
            cfg.set(key, value)
    for key, value in (("temperature", "x"), ("cloud_storages.a.conflict_policy", "x"), ("cloud_storages.a", "x"), ("model", "")):
        with pytest.raises(ValueError):
            cfg.set(key, value)
    assert cfg.with_default("a").active_storage("zz").concurrency == 7
    with pytest.raises(KeyError):
        cfg.with_default("b")
    path.write_text("{")
    cfg, error = config.load(path)
    assert "recreated" in error and cfg == config.Config()
    lintrc = tmp_path / ".markdownlint.json"
    assert config.load_lint_config(folders=(str(tmp_path),)) == {}
    config.write_lint_config(str(lintrc))
    assert all(config.load_lint_config(folders=(str(tmp_path),)).values())
    lintrc.write_text('{"MD013": false}')
    assert config.load_lint_config(str(lintrc)) == {}
    lintrc.write_text('{"MD013": {"enabled": false, "options": {"x": 1}}}')
    assert config.load_lint_config(str(lintrc)) == {"MD013": False}


def test_stream(spark, tmp_path):
    from folio.streaming import documents

    spark.createDataFrame([(1, "#x"), (2, "# ok\n")], "doc_id long, content string").write.parquet(str(tmp_path / "in"))
    q = documents.append_issues(documents.read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r["rule"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["MD018", "MD047"]
