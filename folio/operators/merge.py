"""Front matter, heading shifts, sanitising and the ordered merge of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import WS, at, base_name, file_dir, join_lines, let, lines, replace_first, title_case

FRONT_MATTER = rf"(?s)\A---[{WS}]*\n(.*?)\n---[{WS}]*\n"
ATX = rf"(?d)\A(#{{1,6}})[{WS}]+(.+)\z"
UNDER_1, UNDER_2 = rf"\A=+[{WS}]*\z", rf"\A-+[{WS}]*\z"


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")


def repair_front_matter(text: Column) -> Column:
    """Front matter with lists, none of which has a space after its hyphens, gets those spaces; any other is removed."""
    yaml = F.regexp_extract(text, FRONT_MATTER, 1)
    tight = F.contains(yaml, F.lit("\n-")) & ~F.contains(yaml, F.lit("\n- "))
    return F.when(tight, replace_first(text, yaml, F.replace(yaml, F.lit("\n-"), F.lit("\n- ")))).otherwise(strip_front_matter(text))


def _scanned(text: Column) -> Column:
    """Lines without their ends (``\\n`` or ``\\r\\n``); a final line end does not begin another line."""
    ls = lines(text)
    ls = F.when(F.try_element_at(ls, F.lit(-1)) == "", F.slice(ls, F.lit(1), F.size(ls) - 1)).otherwise(ls)
    return F.transform(ls, lambda s: F.regexp_replace(s, r"\r\z", ""))


def _at_level(level: Column, text: Column) -> Column:
    return F.when(level <= 6, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(F.concat(F.lit("**"), text, F.lit("**")))


def shift_lines(ls: Column, by: int) -> Column:
    """A line followed by a run of underlines becomes a heading by the last of the run.

    In a run all underlines belong to the line before it, unless that is empty or there is none: then the first stands for itself.
    """
    is_under = lambda s: s.rlike(UNDER_1) | s.rlike(UNDER_2)
    taken = F.transform(ls, lambda s, i: is_under(s) & (i > 0) & F.coalesce(is_under(at(ls, i - 1)) | (at(ls, i - 1) != ""), F.lit(False)))
    own = F.filter(F.transform(taken, lambda t, i: F.when(~t, i)), lambda x: x.isNotNull())

    def one(own: Column, i: Column, k: Column) -> Column:
        s = at(ls, i)
        end = F.coalesce(at(own, k + 1), F.size(ls))
        atx = F.regexp_extract(s, ATX, 1)
        plain = F.when(atx != "", _at_level(F.char_length(atx) + by, F.regexp_extract(s, ATX, 2))).otherwise(s)
        under = F.when(at(ls, end - 1).rlike(UNDER_1), 1).otherwise(2)
        return F.when(end > i + 1, _at_level(under + by, s)).otherwise(plain)

    return let(own, lambda o: F.transform(o, lambda i, k: one(o, i, k)))


def shift_headings(docs: DataFrame, by: int, content: str = "content") -> DataFrame:
    """Heading levels moved by ``by``; past level 6 they become bold text. 0 is the identity, a level below 0 an error."""
    if by == 0:
        return docs
    if by < -1:
        low = F.exists(_scanned(F.col(content)), lambda s: (F.char_length(F.regexp_extract(s, ATX, 1)) > 0) & (F.char_length(F.regexp_extract(s, ATX, 1)) < -by) | s.rlike(UNDER_1) & F.lit(by < -1) | s.rlike(UNDER_2) & F.lit(by < -2))
        docs = docs.withColumn(content, F.when(low, F.raise_error(F.lit("heading level below 0"))).otherwise(F.col(content)))
    return docs.withColumn(content, let(_scanned(F.col(content)), lambda ls: join_lines(shift_lines(ls, by))))


def file_title(path: Column) -> Column:
    """Title in words from a file name."""
    name = F.regexp_replace(F.regexp_replace(base_name(path), r"\.md\z", ""), r"\.markdown\z", "")
    return title_case(F.translate(name, "_-", "  "))


def add_title(docs: DataFrame, level: int = 1, content: str = "content", path: str = "path") -> DataFrame:
    head = _at_level(F.lit(level), file_title(F.col(path)))
    return docs.withColumn(content, F.concat(head, F.lit("\n\n"), F.col(content)))


def sanitise_line(s: Column) -> Column:
    """A space after the first colon of a line that has none with one (unless indented), else after a leading hyphen."""
    colon = F.contains(s, F.lit(":")) & ~F.contains(s, F.lit(": ")) & ~s.rlike(r"\A(    |\t)")
    hyphen = F.startswith(s, F.lit("-")) & ~F.startswith(s, F.lit("- ")) & (F.octet_length(s) > 1)
    at_ = F.instr(s, F.lit(":"))
    spaced = F.concat(F.substring(s, F.lit(1), at_), F.lit(" "), F.substring(s, at_ + 1, F.char_length(s)))
    return F.when(colon, spaced).when(hyphen, F.concat(F.lit("- "), F.substring(s, F.lit(2), F.char_length(s)))).otherwise(s)


def sanitise(text: Column, times: int = 1) -> Column:
    """Every line sanitised, ``times`` times over; twice is not the same as once."""
    for _ in range(times):
        text = join_lines(F.transform(lines(text), sanitise_line))
    return text


def _shares(docs: DataFrame, shift: int, file_as_title: bool, order: str, content: str, path: str, sanitised: int) -> DataFrame:
    """``ord, text``: what each document gives to the merged one; lines are sanitised one by one, so before the merge as well as after it."""
    df = docs.withColumn(content, strip_front_matter(F.col(content)))
    df = shift_headings(df, shift, content)
    if file_as_title:
        df = add_title(df, 1 + shift, content, path)
    return df.select(F.col(order).alias("ord"), sanitise(F.col(content), sanitised).alias("text"))


def merge(docs: DataFrame, shift: int = 0, file_as_title: bool = False, order: str = "ord", content: str = "content", path: str = "path", sanitised: int = 1) -> DataFrame:
    """One row ``merged``: documents by ``order``, without front matter, shifted and titled, two line feeds between, sanitised."""
    one = _shares(docs, shift, file_as_title, order, content, path, sanitised).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("ds"))
    return one.select(F.array_join(F.transform("ds", lambda d: d["text"]), "\n\n").alias("merged"))


def merge_rows(docs: DataFrame, shift: int = 0, file_as_title: bool = False, order: str = "ord", content: str = "content", path: str = "path", sanitised: int = 1) -> DataFrame:
    """``ord, text`` in order: the rows that ``merge`` puts into one, for merged documents beyond one task; null content gives none.

    They are dealt by ranges of the order, whose sample holds no text, so written as text with two line feeds as ``lineSep`` the parts are the merged document, which then ends in two more.
    """
    return _shares(docs, shift, file_as_title, order, content, path, sanitised).where("text IS NOT NULL").repartitionByRange(F.col("ord").asc_nulls_first()).sortWithinPartitions(F.col("ord").asc_nulls_first(), "text")


def source_dirs(docs: DataFrame, order: str = "ord", path: str = "path") -> DataFrame:
    """``dir, first_ord``: distinct folders, to be read in order of first appearance."""
    return docs.groupBy(file_dir(F.col(path)).alias("dir")).agg(F.min(order).alias("first_ord"))
