import pytest
from pyspark.sql import functions as F

from folio.operators import fix, fmt, lint, report

DOCUMENTS = [
    ("# Title\n\nThis is valid markdown.\n", [], 0),
    ("# Title  \n\nContent with trailing spaces.  \n", ["MD009"], 2),
    ("# Title\n\n\tContent with hard tab.\n", ["MD010"], 1),
    ("# Title\n\n\n\nContent after multiple blank lines.\n", ["MD012"], 2),
    ("#Title\n\nContent.\n", ["MD018"], 1),
    ("#  Title\n\nContent.\n", ["MD019"], 1),
    ("Some text\n # Title\n\nContent.\n", ["MD023"], 1),
    ("# Title\nSome text\n- List item\n\nContent.\n", ["MD032"], 1),
    ("# Title\n\n- List item\nSome text\n", ["MD032"], 1),
    ("# Title\n\nContent without final newline", ["MD047"], 1),
    ("# Title\n\nContent.\n\n", ["MD047", "MD012"], 2),
    ("# A\n### B\n", ["MD001"], 1),
    ("### A\n# B\n## C\n", [], 0),
    ("A\n===\n# B\n", [], 0),
    ("é" * 41 + "\n", ["MD013"], 1),
    ("a" * 80 + "\n", [], 0),
    ("#\tx\n", ["MD018", "MD010"], 2),
    ("", [], 0),
]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["line"], r["rule"], r["message"], r["context"]))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_documents(md):
    rows = found(lint.lint(md(*[d for d, _, _ in DOCUMENTS])))
    for i, (text, rules, n) in enumerate(DOCUMENTS):
        got = rows.get(i, [])
        assert len(got) == n, (text, got)
        assert set(rules) <= {g[1] for g in got}, (text, got)


def test_window_form_is_the_same(md):
    docs = md(*[d for d, _, _ in DOCUMENTS], "* * *\ntext\n+ a\n\n\n \n- b", "\n\n\n", "###### a\n#\n##\tq", None)
    assert found(lint.lint(docs)) == found(lint.window_issues(docs))


LINES = [
    ("MD047", ["# Title", "Content", ""], 0),
    ("MD047", ["# Title", "Content"], 1),
    ("MD047", ["# Title", "Content", "", ""], 1),
    ("MD047", [], 0),
    ("MD032", ["# Title", "", "- Item 1", "- Item 2", "", "Content after list"], 0),
    ("MD032", ["# Title", "Some text", "- Item 1", "", "Content after list"], 1),
    ("MD032", ["# Title", "", "- Item 1", "Content after list"], 1),
    ("MD032", ["# Title", "Some text", "- Item 1", "Content after list"], 2),
]
ONE_LINE = {
    "MD018": (["#Bad heading", "##Bad heading", "###Bad heading"], ["# Proper heading", "## Another proper heading", "### Yet another proper heading", "Not a heading", ""]),
    "MD019": (["#  Bad heading", "##  Bad heading", "###   Very bad heading"], ["# Proper heading", "## Another proper heading", "Not a heading", ""]),
    "MD023": ([" # Bad heading", "  ## Very bad heading"], ["# Proper heading", "Not a heading", ""]),
}


def test_rules_on_lines(spark):
    cases = LINES + [(r, [s], 1) for r, (yes, _) in ONE_LINE.items() for s in yes] + [(r, [s], 0) for r, (_, no) in ONE_LINE.items() for s in no]
    df = spark.createDataFrame([(i, r, ls) for i, (r, ls, _) in enumerate(cases)], "i int, rule string, ls array<string>")
    chosen = F.lit(None).cast("int")
    for r in {c[0] for c in cases}:
        chosen = F.when(F.col("rule") == r, F.size(lint.issues_of_lines(F.col("ls"), [r]))).otherwise(chosen)
    got = {r["i"]: r["n"] for r in df.select("i", chosen.alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == [n for _, _, n in cases]


def test_rule_selection():
    assert lint.select_rules(["MD009"], ["MD009"]) == []
    assert lint.select_rules(["MD999"]) == []
    assert lint.select_rules(None, ["MD013"]) == sorted(set(lint.RULES) - {"MD013"})
    assert "MD013" not in lint.select_rules(config={"MD013": False, "MD010": None})
    assert lint.select_rules(["MD013"], config={"MD013": False}) == ["MD013"]


def test_size_guard(md):
    fit, large = lint.size_guard(md("a", "b" * (lint.MAX_BYTES + 1), None))
    assert [r["doc_id"] for r in fit.collect()] == [0, 2]
    assert [r["doc_id"] for r in large.collect()] == [1]


@pytest.mark.parametrize(("text", "count"), [("# Title  \n\nContent with trailing spaces.  \n", 2), ("# Title\n\n\tContent with hard tab.\n", 1), ("# Title\n\n\n\nContent after multiple blank lines.\n", 2)])
def test_fix_counts(md, text, count):
    row = fix.fix(md(text)).first()
    assert row["fixed_count"] == count
    assert row["content_before"] == text != row["content"]
    assert all(x["fixed"] for x in row["issues"])


def test_single_fixers(md):
    one = lambda rule, text: fix.fix_one(md(text), rule).first()[-2:]
    assert one("MD032", "a\n- x\n- y\nb") == ("a\n\n- x\n\n- y\nb", 2)
    assert one("MD047", "a\n\n") == ("a\n", 1)
    assert one("MD047", "\n \n") == ("", 1)
    assert one("MD018", "  #a\n##b") == ("# a\n## b", 2)
    assert one("MD019", " #\t\tb") == ("# b", 1)
    assert one("MD023", "   # x\n#") == ("# x\n#", 1)
    assert one("MD012", "a\n\n \n\nb") == ("a\n\nb", 2)


def test_fix_pipeline(md):
    docs = md("x\t", "# ok\n", "# A\n\n### B\n", "é" * 41 + "\n", "# T\ntext\n")
    a, clean, jump, long_, tight = fix.fix(docs).orderBy("doc_id").collect()
    assert (a["content"], a["fixed_count"]) == ("x\n", 2)  # trailing tab once, final newline once
    assert clean["fixed_count"] == 0 and clean["content"] == "# ok\n"
    assert jump["fixed_count"] == 0 and jump["content"] == "# A\n\n### B\n" and not jump["issues"][0]["fixed"]
    assert long_["fixed_count"] == 0 and not long_["issues"][0]["fixed"]
    assert tight["fixed_count"] == 0 and tight["content"] == "# T\ntext\n"  # without issues nothing is formatted


def test_formatter(md):
    texts = {
        "a\n##Title\nb\n": "a\n\n## Title\n\nb\n",
        "[ a  b ]( http://x/ y )": "[a b](http://x/y)",
        "[a](#b c )": "[a](#bc)",
        "( a   b )": "(a b)",
        "见(  https://x  )": "见(  https://x  )",
        "(  q  r ) (see  https://x ) ( s )": "(q r) (see  https://x ) (s)",
        "中文abc测试": "中文 abc 测试",
        "a\n\n\n\nb": "a\n\nb",
        "#": "# ",
        "": "",
    }
    got = [r["formatted"] for r in fmt.format_document(md(*texts)).orderBy("doc_id").collect()]
    assert got == list(texts.values())
    assert fmt.format_document(md("#x"), enabled=False).first()["formatted"] == "#x"


def test_collapse_is_idempotent(md):
    once = fmt.format_document(md("a\n \n\n# b\n\n\n(  c )")).select("doc_id", F.col("formatted").alias("content"))
    assert fmt.format_document(once).first()["formatted"] == once.first()["content"]


def test_reports(md):
    fixed = fix.fix(md("#Title\n\nContent.\n")).withColumn("path", F.lit("a.md"))
    assert report.document_text(fixed).first()["report"] == "a.md:\n  ✓ Line 1: No space after hash on atx style heading (MD018)\n  Fixed 1 issues"
    plain = lint.issues(md("#Title\n\nContent.\n")).withColumn("path", F.lit("a.md"))
    rows = lint.explode_issues(plain, "doc_id", "path")
    assert report.annotations(rows).first()["report"] == "::error file=a.md,line=1::No space after hash on atx style heading (MD018)"
    assert report.default_lines(rows, verbose=True).first()["report"].endswith("(MD018)\n    Context: #Title")
    assert plain.select(report.json_report(plain)).first()[0] == '{"fixed_count":0,"filename":"a.md","issues":[{"line":1,"rule":"MD018","message":"No space after hash on atx style heading","context":"#Title"}]}'
    assert report.summary(plain).first() == (1, 1, 0, 1)
    assert report.summary(fixed, autofix=True).first()["exit_code"] == 0
