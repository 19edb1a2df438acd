"""Lint rules as narrow array expressions: a document's issues come from its own row, without a shuffle.

A rule maps the array of a document's lines to an array of issues ``(line, rule, message, context)``.  ``issues`` evaluates the
enabled rules of each document; ``explode_issues`` makes a row of each, by an outer generator, since an inner one would make the
optimizer evaluate the whole expression a second time as a filter.  ``window_issues`` says the same with windows over a table
of lines and serves as a cross-check.

Defined cases: null content gives a null issue array, hence no issue rows; the empty document has one empty line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import at, let, lines, trim

ISSUE = "array<struct<line:int,rule:string,message:string,context:string>>"
#: Identifiers and descriptions of the rules.
RULES = {
    "MD001": "Heading levels should only increment by one level at a time",
    "MD003": "Heading style should be consistent",
    "MD009": "Trailing spaces",
    "MD010": "Hard tabs",
    "MD012": "Multiple consecutive blank lines",
    "MD013": "Line length",
    "MD018": "No space after hash on atx style heading",
    "MD019": "Multiple spaces after hash on atx style heading",
    "MD023": "Headings must start at the beginning of the line",
    "MD032": "Lists should be surrounded by blank lines",
    "MD047": "Files should end with a single newline character",
}
#: Messages that differ from the description.
TOO_LONG = "Line too long"
BEFORE_LIST = "Lists should be surrounded by blank lines (missing blank line before list)"
AFTER_LIST = "Lists should be surrounded by blank lines (missing blank line after list)"
MANY_NEWLINES = "Files should end with a single newline character (multiple trailing newlines found)"
MAX_BYTES, MAX_LINE_BYTES = 10 * 1024 * 1024, 80

NO_SPACE, WIDE_SPACE, INDENTED, ITEM = r"\A#+[^# ]", r"\A#+  +", r"\A +#", r"\A[*+-] "


def _issue(i: Column, rule: str, context: Column | None, message: str | None = None) -> Column:
    ctx = F.lit(None).cast("string") if context is None else context
    return F.struct((i + 1).cast("int").alias("line"), F.lit(rule).alias("rule"), F.lit(message or RULES[rule]).alias("message"), ctx.alias("context"))


def _is_item(t: Column) -> Column:
    return t.rlike(ITEM)


@dataclass(frozen=True)
class Line:
    """What a rule sees of a line: itself, trimmed, its index from 0, and its neighbours trimmed (null at the ends)."""

    raw: Column
    t: Column
    i: Column
    prev: Column
    next: Column


def _md032(x: Line) -> list[Column]:
    before = F.when(_is_item(x.t) & (x.prev != "") & ~_is_item(x.prev), _issue(x.i, "MD032", x.t, BEFORE_LIST))
    behind = F.when(_is_item(x.t) & (x.next != "") & ~_is_item(x.next), _issue(x.i + 1, "MD032", x.next, AFTER_LIST))
    return [before, behind]


#: Rules on single lines and their neighbours: each gives issues that are null where it does not fire.
LINE_RULES: dict[str, Callable[[Line], list[Column]]] = {
    "MD003": lambda x: [],  # only one style is ever told apart, so nothing is inconsistent
    "MD009": lambda x: [F.when(F.endswith(x.raw, F.lit(" ")) | F.endswith(x.raw, F.lit("\t")), _issue(x.i, "MD009", x.raw))],
    "MD010": lambda x: [F.when(F.contains(x.raw, F.lit("\t")), _issue(x.i, "MD010", x.raw))],
    "MD012": lambda x: [F.when((x.t == "") & (x.prev == ""), _issue(x.i, "MD012", None))],
    "MD013": lambda x: [F.when(F.octet_length(x.raw) > MAX_LINE_BYTES, _issue(x.i, "MD013", x.raw, TOO_LONG))],
    "MD018": lambda x: [F.when(F.startswith(x.t, F.lit("#")) & x.t.rlike(NO_SPACE), _issue(x.i, "MD018", x.t))],
    "MD019": lambda x: [F.when(F.startswith(x.t, F.lit("#")) & x.t.rlike(WIDE_SPACE), _issue(x.i, "MD019", x.t))],
    "MD023": lambda x: [F.when(F.startswith(x.raw, F.lit(" ")) & x.raw.rlike(INDENTED), _issue(x.i, "MD023", x.raw))],
    "MD032": _md032,
}


def _line_issues(ls: Column, ts: Column, rules: list[str]) -> Column:
    def one(s: Column, i: Column) -> Column:
        x = Line(s, at(ts, i), i, at(ts, i - 1), at(ts, i + 1))
        return F.array_compact(F.array(*[c for r in rules for c in LINE_RULES[r](x)]))

    return F.flatten(F.transform(ls, one))


def _md001(ts: Column) -> Column:
    """Headings that are more than one level below the heading before them."""
    level = lambda t: F.char_length(t) - F.char_length(F.ltrim(t, F.lit("#")))
    marked = F.transform(ts, lambda t, i: F.when(F.startswith(t, F.lit("#")), F.struct(i.alias("i"), t.alias("t"), level(t).alias("level"))))
    found = lambda hs: F.transform(hs, lambda h, k: F.when(h["level"] > at(hs, k - 1)["level"] + 1, _issue(h["i"], "MD001", h["t"])))
    return F.array_compact(let(F.array_compact(marked), found))


def _md047(ls: Column) -> Column:
    n = F.size(ls)
    last, second = F.try_element_at(ls, F.lit(-1)), F.try_element_at(ls, F.lit(-2))
    out = F.when(last != "", F.array(_issue(n - 1, "MD047", None))).when((n > 1) & (last == "") & (second == ""), F.array(_issue(n - 2, "MD047", None, MANY_NEWLINES)))
    return F.coalesce(out, F.array().cast(ISSUE))


def select_rules(enabled: Iterable[str] | None = None, disabled: Iterable[str] = (), config: dict[str, bool] | None = None) -> list[str]:
    """Rules that run: all, less what ``config`` turns off; ``enabled`` replaces that; ``disabled`` is subtracted. Unknown names count for nothing."""
    on = {r: True for r in RULES} | {r: v for r, v in (config or {}).items() if r in RULES and v is not None}
    chosen = {r for r, v in on.items() if v}
    if enabled:
        chosen = set(RULES) & set(enabled)
    return sorted(chosen - set(disabled))


def issues_of_lines(ls: Column, rules: Iterable[str] | None = None) -> Column:
    """Issues of an array of lines under the given rules (all by default), by line, rule and message."""
    chosen = sorted(RULES if rules is None else set(rules) & set(RULES))
    single = [r for r in chosen if r in LINE_RULES and r != "MD003"]

    def found(ts: Column) -> Column:
        parts = [*([_line_issues(ls, ts, single)] if single else []), *([_md001(ts)] if "MD001" in chosen else []), *([_md047(ls)] if "MD047" in chosen else [])]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    if not set(chosen) - {"MD003"}:
        return F.when(ls.isNotNull(), F.array().cast(ISSUE))
    return F.array_sort(let(F.transform(ls, trim), found))


def issues(docs: DataFrame, rules: Iterable[str] | None = None, content: str = "content") -> DataFrame:
    """``docs`` with ``issues``; lines are split once."""
    split = docs.withColumn("_lines", lines(F.col(content)))
    return split.withColumn("issues", issues_of_lines(F.col("_lines"), rules)).drop("_lines")


def explode_issues(linted: DataFrame, *keys: str) -> DataFrame:
    """A row for each issue: the key columns, then ``line, rule, message, context``."""
    rows = linted.select(*keys, F.inline_outer("issues"))
    return rows.where(F.col("rule").isNotNull())


def lint(docs: DataFrame, rules: Iterable[str] | None = None, key: str = "doc_id", content: str = "content") -> DataFrame:
    return explode_issues(issues(docs, rules, content), key)


def size_guard(docs: DataFrame, content: str = "content", limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents that may be linted, and those that are too large; a document without content fits."""
    fits = F.coalesce(F.octet_length(content) <= limit, F.lit(True))
    return docs.where(fits), docs.where(~fits)


def line_table(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """``key, line_no, line`` with line numbers from 1."""
    rows = docs.select(key, F.posexplode_outer(lines(F.col(content))).alias("pos", "line"))
    return rows.where(F.col("line").isNotNull()).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def window_issues(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """All rules over a table of lines, by windows on the document: the same rows as ``lint`` where ``key`` is unique (rows that share a key are read as one)."""
    w = Window.partitionBy(key).orderBy("line_no")
    t = line_table(docs, key, content).withColumn("t", trim(F.col("line"))).withColumn("head", F.startswith("t", F.lit("#")))
    t = t.withColumn("level", F.when(F.col("head"), F.char_length("t") - F.char_length(F.ltrim("t", F.lit("#")))))
    t = t.withColumn("prev_level", F.last("level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    for name, c in (("prev", F.lag("t").over(w)), ("next", F.lead("t").over(w)), ("prev_line", F.lag("line").over(w)), ("next_line", F.lead("line").over(w))):
        t = t.withColumn(name, c)
    n, line, tt = F.col("line_no").cast("int"), F.col("line"), F.col("t")
    item = lambda c: F.col(c).rlike(ITEM)
    out = lambda test, rule, ctx=None, message=None, at_line=n: F.when(test, F.struct(at_line.alias("line"), F.lit(rule).alias("rule"), F.lit(message or RULES[rule]).alias("message"), (F.lit(None).cast("string") if ctx is None else ctx).alias("context")))
    found = F.array(
        out(F.col("head") & (F.col("level") > F.col("prev_level") + 1), "MD001", tt),
        out(line.rlike(r"[ \t]\z"), "MD009", line),
        out(F.contains(line, F.lit("\t")), "MD010", line),
        out((tt == "") & (F.col("prev") == ""), "MD012"),
        out(F.octet_length(line) > MAX_LINE_BYTES, "MD013", line, TOO_LONG),
        out(tt.rlike(NO_SPACE), "MD018", tt),
        out(tt.rlike(WIDE_SPACE), "MD019", tt),
        out(line.rlike(INDENTED), "MD023", line),
        out(item("t") & (F.col("prev") != "") & ~item("prev"), "MD032", tt, BEFORE_LIST),
        out(item("t") & (F.col("next") != "") & ~item("next"), "MD032", F.col("next"), AFTER_LIST, (n + 1)),
        out(F.col("next_line").isNull() & (line != ""), "MD047"),
        out(F.col("next_line").isNull() & (line == "") & (F.col("prev_line") == ""), "MD047", None, MANY_NEWLINES, (n - 1)),
    )
    return t.select(key, F.inline_outer(F.filter(found, lambda x: x.isNotNull()))).where(F.col("rule").isNotNull())
