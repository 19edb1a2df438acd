"""Documents from files. Reading is Spark's own binary source; selection by name is a predicate on the path."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Which paths each kind of scan takes: lint and export fold case, download and upload do not, translation takes ``.md`` only.
PREDICATES = {
    "lint": r"(?i)\.(md|markdown)\z",
    "export": r"(?i)\.(md|markdown)\z",
    "download": r"\.(md|markdown)\z",
    "upload": r"\.(md|markdown)\z",
    "translate": r"\.md\z",
}


def takes(path: Column, kind: str) -> Column:
    return path.rlike(PREDICATES[kind])


#: Lead and trail bytes of double-byte characters.
LEADS, TRAILS = range(0x81, 0xFF), range(0x40, 0xFF)


@cache
def _gbk() -> tuple[str, str]:
    """A character for each pair of lead and trail byte, and a pattern of the pairs that are characters; both from the codec, leads of like trails together."""
    table, like = [], {}
    for lead in LEADS:
        trails = ""
        for trail in TRAILS:
            char = bytes((lead, trail)).decode("gbk", "replace")
            table.append(char if len(char) == 1 and char != "\ufffd" else "\ufffd")
            trails += "" if table[-1] == "\ufffd" else chr(trail)
        if trails:
            like.setdefault(trails, []).append(lead)
    one = lambda codes: "[" + "".join(f"\\x{c:02x}" for c in codes) + "]"
    return "".join(table), "|".join(one(leads) + one(map(ord, trails)) for trails, leads in like.items())


def decode_gbk(raw: Column) -> Column:
    """Text of double-byte bytes; a byte that begins no character is U+FFFD.

    Bytes become characters of the same numbers, a pattern cuts them into characters, runs of ASCII and other single bytes, and pairs are looked up in a table.
    """
    table, pairs = _gbk()
    cut = F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit(f"(?s){pairs}|[\\x00-\\x7f]+|."), F.lit(0))
    place = lambda t: (F.ascii(t) - LEADS[0]) * len(TRAILS) + F.ascii(F.substring(t, 2, 1)) - TRAILS[0]
    char = lambda t: F.when(F.ascii(t) < 0x80, t).when(F.char_length(t) == 2, F.get(F.split(F.lit(table), ""), place(t))).otherwise(F.lit("\ufffd"))
    return F.array_join(F.transform(cut, char), "")


def decoded(raw: Column) -> Column:
    """Text of bytes: UTF-8 if they are valid as such, else GBK as a whole."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(decode_gbk(raw))


def _local(path: Column) -> Column:
    """Path without scheme and authority."""
    return F.regexp_replace(path, r"\A[a-z][a-z0-9+.-]*:(//[^/]*)?", "")


def scan(spark: SparkSession, root: str, kind: str = "lint") -> DataFrame:
    """``path, content, raw, size`` of the files below ``root`` that the kind takes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(_local(F.col("path")).alias("path"), F.col("content").alias("raw"), F.col("length").alias("size"))
    rows = rows.where(takes(F.col("path"), kind))
    return rows.select("path", (decoded(F.col("raw")) if kind == "export" else F.col("raw").cast("string")).alias("content"), "raw", "size")


def scan_globs(spark: SparkSession, patterns: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Files of the lint patterns, and warnings for those that name nothing; a pattern that climbs (``..``) is refused."""
    found, warnings = None, []
    for p in patterns:
        if ".." in p:
            raise ValueError(f"path may not contain '..': {p}")
        try:
            one = spark.read.format("binaryFile").load(p)
        except AnalysisException:
            warnings.append(f"nothing matches {p}")
            continue
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "path string, content string, size long"), warnings
    rows = found.select(_local(F.col("path")).alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"))
    return rows.where(takes(F.col("path"), "lint")).dropDuplicates(["path"]), warnings


def ordered(docs: DataFrame, path: str = "path") -> DataFrame:
    """``docs`` with ``ord``, its path, which orders bytewise; merging sorts by it."""
    return docs.withColumn("ord", F.col(path))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, md5`` of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_local(F.col("path")).alias("path"), F.col("length").alias("size"), F.md5("content").alias("md5"))


def write_texts(rows: DataFrame, path: str = "target", text: str = "output") -> DataFrame:
    """Write each row's text to its path by a rename, on the executors; ``path, error``. The folder must be one that they share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath
        import uuid

        from pyarrow import fs

        for pdf in batches:
            errors = []
            for name, body in zip(pdf[path], pdf[text], strict=True):
                try:
                    store, at = fs.FileSystem.from_uri(name if "://" in name else f"file://{name}")
                    store.create_dir(posixpath.dirname(at), recursive=True)
                    tmp = f"{at}.{uuid.uuid4().hex}"
                    with store.open_output_stream(tmp) as f:
                        f.write((body or "").encode("utf-8", "surrogatepass"))
                    store.move(tmp, at)
                    errors.append(None)
                except Exception as e:  # one file's failure is its row
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf[path], "error": errors})

    return rows.where(F.col(text).isNotNull()).select(path, text).mapInPandas(run, "path string, error string")
