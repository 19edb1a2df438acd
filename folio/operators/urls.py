"""Addresses: globs, limits, sections, titles."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import title_case


def glob_to_regex(glob: str) -> str | None:
    """Anchored pattern of a glob (``* ** ? [..] [!..] {a,b} \\x``), in which ``*`` crosses slashes; None if it is malformed."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\":
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            end = glob.find("]", i + (glob[i : i + 1] == "!") + 1)
            if end < 0:
                return None
            body = glob[i:end]
            negated, body = body.startswith("!"), body.removeprefix("!")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&~|])", r"\\\1", body) + "]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
    return None if depth else r"(?s)\A" + "".join(out) + r"\z"


def _any(url: Column, globs: Iterable[str]) -> tuple[Column | None, int]:
    test, n = None, 0
    for g in globs:
        pattern = glob_to_regex(g)
        if pattern is None:
            warnings.warn(f"glob left out: {g!r}", stacklevel=3)
            continue
        n += 1
        one = url.rlike(pattern)
        test = one if test is None else test | one
    return test, n


def filter_urls(df: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), col: str = "url") -> DataFrame:
    """Rows whose whole address matches any include (or there is none that is valid) and no exclude. A null address matches nothing."""
    yes, _ = _any(F.col(col), include)
    no, _ = _any(F.col(col), exclude)
    if yes is not None:
        df = df.where(yes)
    return df.where(~F.coalesce(no, F.lit(False))) if no is not None else df


def limit_urls(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first ``n`` by ``seq``; 0 keeps all."""
    return df.orderBy(seq).limit(n) if n > 0 else df


def _well_formed(url: Column) -> Column:
    """Null where an address cannot be parsed: bad escapes, control characters, a space or bad escape in the host, a colon before any scheme."""
    bad = url.rlike(r"%(?![0-9A-Fa-f]{2})") & ~url.rlike(r"\A[^%]*[?#]") | url.rlike(r"[\x00-\x1F\x7F]") | url.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[ <>\"]") | url.rlike(r"\A:") | url.rlike(r"\A[^A-Za-z/?#][^/?#]*:")
    return F.when(~bad, url)


def path_of(url: Column) -> Column:
    """Percent-decoded path of an address, null if it is malformed; ``+`` stays."""
    rest = F.regexp_replace(F.regexp_replace(_well_formed(url), r"(?s)[?#].*\z", ""), r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?", "")
    return F.when(F.contains(rest, F.lit("%")), F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))).otherwise(rest)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_well_formed(url), r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(host, r"\A\[|\]\z", "")


def section(url: Column) -> Column:
    """First element of the path, ``ROOT`` without one or if the address is malformed."""
    first = F.substring_index(F.trim(path_of(url), F.lit("/")), "/", 1)
    return F.coalesce(F.when(first != "", first), F.lit("ROOT"))


def title_from_url(url: Column) -> Column:
    """Last element of the path without its extension, words capitalised; the host where that leaves nothing."""
    path = path_of(url)
    last = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    base = F.regexp_replace(last, r"\.[^.]*\z", "")
    words = title_case(F.translate(base, "-_", "  "))
    return F.when(path.isNull(), url).when((base == "") | (base == "."), host_of(url)).otherwise(words)
