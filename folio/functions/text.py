"""Text primitives.

Lengths and cuts are in UTF-8 bytes where a name says so; white space is either all of Unicode's (``trim``) or the ASCII class
``[\\t\\n\\f\\r ]`` (``WS``), never the engine's default.  Null text gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points with the Unicode White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: ASCII white space as a character class body.
WS = r"\t\n\f\r "


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends.

    The engine's trimming by a set of characters measures the whole text first, so it runs only where an end is white.
    """
    white = lambda end: F.contains(F.lit(WHITE_SPACE), end)
    return F.when(white(F.left(c, F.lit(1))) | white(F.right(c, F.lit(1))), F.trim(c, F.lit(WHITE_SPACE))).otherwise(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it (a lambda's variable isn't inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(c: Column) -> Column:
    """Parts between line feeds; the empty text has one empty line, a final line feed gives a last empty one."""
    return F.split(c, "\n", -1)


def join_lines(a: Column) -> Column:
    return F.array_join(a, "\n")


def squeeze(c: Column) -> Column:
    """Runs of ASCII white space as one space, Unicode white space trimmed first."""
    return F.regexp_replace(trim(c), f"[{WS}]+", " ")


def preview(c: Column, n: int) -> Column:
    """Trimmed; beyond ``n`` bytes the first ``n`` and three dots, a character that is cut through as U+FFFD."""
    cut = F.make_valid_utf8(F.substring(F.encode(trim(c), "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(trim(c)) <= n, trim(c)).otherwise(F.concat(cut, F.lit("...")))


def at(a: Column, i) -> Column:
    """Element ``i`` from 0, null outside."""
    return F.get(a, F.lit(i) if isinstance(i, int) else i)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the first occurrence of ``old`` (taken literally) replaced; unchanged if there is none."""
    pos = F.instr(text, old)
    return F.when(pos > 0, F.concat(F.substring(text, F.lit(1), pos - 1), new, F.substring(text, pos + F.char_length(old), F.char_length(text)))).otherwise(text)


def replace_matches(text: Column, pattern: str, groups: int, build: Callable[..., Column]) -> Column:
    """``text`` with each match replaced by ``build(group 1, ...)``, which may compute on the groups."""
    found = F.struct(F.split(text, pattern, -1).alias("between"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)])

    def joined(m: Column) -> Column:
        last = F.size(m["between"]) - 1
        return F.array_join(F.transform(m["between"], lambda part, i: F.when(i < last, F.concat(part, build(*[at(m[f"g{g}"], i) for g in range(1, groups + 1)]))).otherwise(part)), "")

    return let(found, joined)


def between_matches(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with ``change`` applied to what lies between matches, the matches kept."""
    found = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("kept"))
    return let(found, lambda m: F.array_join(F.transform(m["parts"], lambda part, i: F.concat(change(part), F.coalesce(at(m["kept"], i), F.lit("")))), ""))


def title_case(c: Column) -> Column:
    """First letter of each word upper-cased, the rest kept.

    In ASCII every character but letters, digits and underscore separates words; beyond ASCII only white space does.
    """
    separator = r"[\x00-/:-@\[-^`{-\x7F" + WHITE_SPACE[6:] + "]"
    upper = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.char_length(w)))
    return between_matches(c, separator, lambda w: F.when(w == "", w).otherwise(upper(w)))


def capitalise(c: Column) -> Column:
    """First character upper case, the rest lower."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, F.lit(2), F.char_length(c))))


def file_dir(path: Column) -> Column:
    """Directory part of a slash-separated path, ``.`` if there is none."""
    cut = F.regexp_replace(path, r"/[^/]*\z", "")
    return F.when(~F.contains(path, F.lit("/")), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the last path element on, empty without one."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def clean_path(path: Column) -> Column:
    """Lexically shortest path: no ``.``, no inner ``..``, no doubled slashes; ``.`` if nothing is left."""
    rooted = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    push = F.aggregate(
        parts, none,
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "..") & rooted, acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.array_join(push, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)
