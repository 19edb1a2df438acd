"""Lint reports as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fixed(df: DataFrame) -> Column:
    return F.coalesce("fixed", F.lit(False)) if "fixed" in df.columns else F.lit(False)


def default_lines(issues: DataFrame, verbose: bool = False) -> DataFrame:
    """``issues`` with ``report``: a mark, line, message and rule; with ``verbose`` the context on a line of its own."""
    head = F.format_string("  %s Line %d: %s (%s)", F.when(_fixed(issues), F.lit("✓")).otherwise(F.lit("✗")), "line", "message", "rule")
    if verbose:
        head = F.concat(head, F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("\n    Context: "), F.col("context"))).otherwise(F.lit("")))
    return issues.withColumn("report", head)


def annotations(issues: DataFrame, filename: str = "path") -> DataFrame:
    """``issues`` with ``report`` as workflow commands, ``notice`` for fixed ones."""
    level = F.when(_fixed(issues), F.lit("notice")).otherwise(F.lit("error"))
    return issues.withColumn("report", F.format_string("::%s file=%s,line=%d::%s (%s)", level, filename, "line", "message", "rule"))


def json_report(linted: DataFrame, filename: str = "path") -> Column:
    """``filename, fixed_count, issues`` as JSON; empty context and unfixed marks are left out, issues never are."""
    kinds = {f.name for f in linted.schema["issues"].dataType.elementType.fields}
    parts = lambda x: [x["line"].alias("line"), x["rule"].alias("rule"), x["message"].alias("message"), F.when(x["context"] != "", x["context"]).alias("context"), *([F.when(x["fixed"], True).alias("fixed")] if "fixed" in kinds else [])]
    count = F.col("fixed_count") if "fixed_count" in linted.columns else F.lit(0)
    return F.to_json(F.struct(count.alias("fixed_count"), F.col(filename).alias("filename"), F.coalesce(F.transform("issues", lambda x: F.struct(*parts(x))), F.array()).alias("issues")), {"ignoreNullFields": "true"})


def document_text(linted: DataFrame, filename: str = "path") -> DataFrame:
    """A report of each document that has issues: its name, a line an issue, and how many were fixed."""
    fixed = "fixed" in {f.name for f in linted.schema["issues"].dataType.elementType.fields}
    line = lambda x: F.format_string("  %s Line %d: %s (%s)", F.when(x["fixed"], F.lit("✓")).otherwise(F.lit("✗")) if fixed else F.lit("✗"), x["line"], x["message"], x["rule"])
    tail = F.when(F.col("fixed_count") > 0, F.format_string("\n  Fixed %d issues", "fixed_count")).otherwise(F.lit("")) if "fixed_count" in linted.columns else F.lit("")
    text = F.concat(F.col(filename), F.lit(":\n"), F.array_join(F.transform("issues", line), "\n"), tail)
    return linted.where(F.size("issues") > 0).select(filename, text.alias("report"))


def summary(linted: DataFrame, autofix: bool = False) -> DataFrame:
    """One row: ``files, issues, fixed`` and ``exit_code`` (1 if there are issues and nothing was to be fixed)."""
    fixed = F.sum("fixed_count") if "fixed_count" in linted.columns else F.lit(0)
    out = linted.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size(F.coalesce("issues", F.array()))), F.lit(0)).cast("long").alias("issues"), F.coalesce(fixed, F.lit(0)).cast("long").alias("fixed"))
    return out.withColumn("exit_code", F.when((F.col("issues") > 0) & ~F.lit(autofix), 1).otherwise(0))


def by_rule(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("doc_id").alias("documents"))
