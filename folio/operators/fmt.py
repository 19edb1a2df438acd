"""The formatter: headings set apart and normalised, links and parentheses cleaned, CJK and Latin spaced, blank runs collapsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import WS, at, between_matches, join_lines, let, lines, replace_matches, squeeze, trim

LINK = rf"(?d)\[(.*?)\]\([{WS}]*(.*?)[{WS}]*\)"
ANCHOR = r"(?d)\]\(#(.*?)\)"
WEB_PARENS = r"\([^)]*https?://[^)]+\)"
PARENS = r"\(([^)]+)\)"
INVISIBLE = rf"[{WS}\p{{Zs}}\p{{Cc}}\p{{Cf}}\p{{Co}}\p{{Cs}}]+"


def is_heading(line: Column) -> Column:
    return F.startswith(trim(line), F.lit("#"))


def heading(line: Column) -> Column:
    """Trimmed, with one space after the hashes (a bare run of hashes gets one too)."""
    return F.regexp_replace(trim(line), rf"\A(#+)[{WS}]*", "$1 ")


def links(line: Column) -> Column:
    """Spaces of link texts squeezed, all white and invisible characters taken out of link targets."""
    cleaned = replace_matches(line, LINK, 2, lambda text, url: F.concat(F.lit("["), squeeze(text), F.lit("]("), F.regexp_replace(trim(url), INVISIBLE, ""), F.lit(")")))
    return replace_matches(cleaned, ANCHOR, 1, lambda a: F.concat(F.lit("](#"), F.regexp_replace(a, f"[{WS}]+", ""), F.lit(")")))


def parentheses(line: Column) -> Column:
    """Spaces inside parentheses squeezed, except in those that hold a web address."""
    inner = lambda part: replace_matches(part, PARENS, 1, lambda c: F.concat(F.lit("("), squeeze(c), F.lit(")")))
    return between_matches(line, WEB_PARENS, inner)


def cjk_spacing(line: Column) -> Column:
    """A space between Han characters and ASCII letters or digits."""
    return F.regexp_replace(F.regexp_replace(line, r"(\p{IsHan})([A-Za-z0-9])", "$1 $2"), r"([A-Za-z0-9])(\p{IsHan})", "$1 $2")


def collapse_blanks(ls: Column) -> Column:
    """Of consecutive blank lines the first, as it is."""
    return F.filter(ls, lambda s, i: (i == 0) | ~((trim(s) == "") & (trim(at(ls, i - 1)) == "")))


def format_lines(ls: Column) -> Column:
    last = F.size(ls) - 1

    def one(s: Column, i: Column) -> Column:
        before = F.when((i > 0) & (trim(at(ls, i - 1)) != ""), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        after = F.when(i < last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        plain = F.when(F.contains(s, F.lit("](")), links(s)).otherwise(s)
        plain = F.when(F.contains(s, F.lit("(")), parentheses(plain)).otherwise(plain)
        spaced = F.when(F.octet_length(s) == F.char_length(s), plain).otherwise(cjk_spacing(plain))  # ASCII holds no Han
        return F.when(is_heading(s), F.concat(before, F.array(heading(s)), after)).otherwise(F.array(spaced))

    return let(F.flatten(F.transform(ls, one)), collapse_blanks)


def format_document(docs: DataFrame, content: str = "content", enabled: bool = True) -> DataFrame:
    """``docs`` with ``formatted``; the identity if not enabled."""
    if not enabled:
        return docs.withColumn("formatted", F.col(content))
    return docs.withColumn("_lines", lines(F.col(content))).withColumn("formatted", join_lines(format_lines(F.col("_lines")))).drop("_lines")
