"""Fixers and the fix pipeline, as expressions over a document's lines.

A fixer maps lines to ``(lines, count)``.  It runs if its rule has an issue in the document as it came, over all lines, in
ascending order of rules; the formatter always follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import WS, at, join_lines, let, lines, trim
from folio.operators import fmt
from folio.operators.lint import RULES, issues_of_lines


def _changed(before: Column, after: Column) -> Column:
    """Number of places in which two arrays of one length differ."""
    return F.size(F.filter(F.zip_with(before, after, lambda a, b: a != b), lambda x: x))


def _each(change: Callable[[Column], Column]):
    return lambda ls: F.transform(ls, change), _changed


def _no_space(s: Column) -> Column:
    t = trim(s)
    return F.when(t.rlike(r"\A#+[^# ]"), F.regexp_replace(t, r"\A(#+)([^# ])", "$1 $2")).otherwise(s)


def _wide_space(s: Column) -> Column:
    t = trim(s)
    return F.when(t.rlike(rf"\A#+[{WS}]{{2,}}"), F.regexp_replace(t, rf"\A(#+)[{WS}]{{2,}}", "$1 ")).otherwise(s)


def _list_spacing(ls: Column) -> Column:
    item = rf"\A[{WS}]*[*+-] "
    return F.flatten(F.transform(ls, lambda s, i: F.when((i > 0) & s.rlike(item) & (trim(at(ls, i - 1)) != ""), F.array(F.lit(""), s)).otherwise(F.array(s))))


def _file_end(ls: Column) -> Column:
    solid = F.filter(F.transform(ls, lambda s, i: F.when(trim(s) != "", i + 1)), lambda x: x.isNotNull())
    n = F.coalesce(F.try_element_at(solid, F.lit(-1)), F.lit(0))
    return F.concat(F.slice(ls, F.lit(1), n), F.array(F.lit("")))


#: Per rule: lines to lines, and the count from lines before and after.
FIXERS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "MD009": _each(lambda s: F.when(F.endswith(s, F.lit(" ")) | F.endswith(s, F.lit("\t")), F.rtrim(s, F.lit(" \t"))).otherwise(s)),
    "MD010": _each(lambda s: F.replace(s, F.lit("\t"), F.lit("    "))),
    "MD012": (fmt.collapse_blanks, lambda old, new: F.size(old) - F.size(new)),
    "MD018": _each(_no_space),
    "MD019": _each(_wide_space),
    "MD023": _each(lambda s: F.regexp_replace(s, r"\A +#", "#")),
    "MD032": (_list_spacing, lambda old, new: F.size(new) - F.size(old)),
    "MD047": (_file_end, lambda old, new: F.lit(1)),
}


def _step(state: Column, rule: str) -> Column:
    """The state ``ls, n`` after one fixer."""
    change, count = FIXERS[rule]
    return let(change(state["ls"]), lambda new: F.struct(new.alias("ls"), (state["n"] + count(state["ls"], new)).cast("int").alias("n")))


#: Rules whose issues are counted when only the formatter has changed the text.
COUNTED = ["MD009", "MD010", "MD012", "MD018", "MD019", "MD023", "MD047"]


def _start(content: str) -> Column:
    return F.struct(lines(F.col(content)).alias("ls"), F.lit(0).alias("n"))


def fix_one(docs: DataFrame, rule: str, content: str = "content") -> DataFrame:
    """``docs`` with ``fixed`` and ``n_fixed`` of one fixer, run whether or not its rule has an issue."""
    done = docs.withColumn("_s", let(_start(content), lambda s: _step(s, rule)))
    return done.withColumn("fixed", join_lines(F.col("_s.ls"))).withColumn("n_fixed", F.col("_s.n").cast("long")).drop("_s")


def fix(docs: DataFrame, rules: Iterable[str] | None = None, content: str = "content") -> DataFrame:
    """``docs`` with ``content_before``, the new content, ``fixed_count`` and ``issues`` (each with ``fixed``).

    Nothing is written in place: ``content_before`` is the backup.  A document whose count is 0 keeps its text.
    """
    chosen = sorted(set(RULES) if rules is None else set(rules) & set(RULES))

    def document(issues: Column) -> Column:
        hit = F.transform(issues, lambda x: x["rule"])

        def run(state: Column, todo: list[str]) -> Column:
            """Fixers one after another, then the formatter: each state is a variable, so the expression stays as long as the list."""
            if not todo:
                made = F.when(F.size(issues) > 0, fmt.format_lines(state["ls"])).otherwise(state["ls"])  # without an issue the text stays as it is
                return let(made, lambda final: finish(state, final))
            now = F.when(F.array_contains(hit, todo[0]), _step(state, todo[0])).otherwise(state)
            return let(now, lambda s: run(s, todo[1:]))

        def finish(state: Column, final: Column) -> Column:
            counted = F.size(F.filter(issues, lambda x: x["rule"].isin(*COUNTED)))
            count = F.when(F.size(issues) == 0, 0).when((state["n"] == 0) & (final != state["ls"]), counted).otherwise(state["n"])
            return F.struct(join_lines(final).alias("text"), count.cast("long").alias("count"), issues.alias("issues"))

        return let(_start(content), lambda s: run(s, [r for r in FIXERS if r in chosen]))

    df = docs.withColumn("content_before", F.col(content)).withColumn("_d", let(let(lines(F.col(content)), lambda ls: issues_of_lines(ls, chosen)), document))
    written = F.col("_d.count") > 0
    marks = F.transform("_d.issues", lambda x: F.struct(x["line"].alias("line"), x["rule"].alias("rule"), x["message"].alias("message"), x["context"].alias("context"), _mark(x, written, chosen).alias("fixed")))
    df = df.withColumn("fixed_count", F.col("_d.count")).withColumn("issues", marks)
    return df.withColumn(content, F.when(written, F.col("_d.text")).otherwise(F.col("content_before"))).drop("_d")


def _mark(issue: Column, written: Column, chosen: list[str]) -> Column:
    """An issue is fixed once its rule has a fixer; once a document is written, all but long lines are."""
    ran = [r for r in FIXERS if r in chosen]
    own = issue["rule"].isin(*ran) if ran else F.lit(False)
    return own | (written & (issue["rule"] != "MD013"))
