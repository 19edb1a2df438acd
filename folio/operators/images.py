"""Image references: extraction, naming, rewriting."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import clean_path, extension, file_dir, let, replace_first

#: Pattern of references that are downloaded or uploaded, and of those that an export rewrites.
REFERENCE = r"!\[([^\]]*)\]\(([^)]+)\)"
EXPORT_REFERENCE = r"(?d)!\[(.*?)\]\((.*?)\)"
#: Content types by extension, and extensions by content type.
CONTENT_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".svg": "image/svg+xml",
    ".bmp": "image/bmp",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
}
DEFAULT_TYPE = "application/octet-stream"
EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp"}


def references(docs: DataFrame, *keys: str, content: str = "content", pattern: str = REFERENCE) -> DataFrame:
    """``keys, pos, alt, url, full_match``: a row for each reference, positions from 0 in order of appearance."""
    group = lambda g: F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(g))
    zipped = F.arrays_zip(group(1).alias("alt"), group(2).alias("url"), group(0).alias("full_match"))
    rows = docs.select(*keys, F.posexplode_outer(zipped).alias("pos", "ref")).where(F.col("ref").isNotNull())
    return rows.select(*keys, "pos", "ref.alt", "ref.url", "ref.full_match")


def remote_url(url: Column) -> Column:
    """The address to fetch: protocol-relative ones get ``https:``; null for anything that isn't on the web."""
    full = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.when(full.rlike(r"\Ahttps?://"), full)


def is_local(url: Column) -> Column:
    return ~url.rlike(r"\A(https?:)?//")


def image_dir(path: Column, explicit: str | None = None, source_dir: str | None = None) -> Column:
    """Where images of a document go: the given folder, else ``images`` under the source folder, else beside the document."""
    if explicit:
        return F.lit(explicit)
    if source_dir:
        return F.lit(posixpath.normpath(posixpath.join(source_dir, "images")))
    return clean_path(F.concat(file_dir(path), F.lit("/images")))


def relative_path(target: Column, start: Column) -> Column:
    """POSIX path of ``target`` as seen from the folder ``start`` (empty: here), both absolute or both from one place; else ``target`` itself. ``.`` if they are the same."""
    here = F.when(start == "", F.lit(".")).otherwise(start)
    parts = lambda c: F.filter(F.split(clean_path(c), "/", -1), lambda p: (p != "") & (p != "."))

    def seen(m: Column) -> Column:
        to, fro = m["to"], m["fro"]
        unlike = F.array_position(F.transform(F.arrays_zip(to.alias("a"), fro.alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False))), False)
        same = F.when(unlike > 0, unlike - 1).otherwise(F.size(to)).cast("int")
        joined = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(fro) - same), F.slice(to, same + 1, F.size(to) - same)), "/")
        return F.when(joined == "", F.lit(".")).otherwise(joined)

    return F.when(F.startswith(target, F.lit("/")) != F.startswith(here, F.lit("/")), clean_path(target)).otherwise(let(F.struct(parts(target).alias("to"), parts(here).alias("fro")), seen))


def file_name(url: Column, disposition: Column | None = None) -> Column:
    """Name from a ``Content-Disposition`` header if it gives one, else from the address; ``image`` as a last resort."""
    last = F.substring_index(F.substring_index(url, "/", -1), "?", 1)
    at_, dot = F.char_length(last) - F.char_length(F.substring_index(last, "@", -1)), F.char_length(last) - F.char_length(F.substring_index(last, ".", -1))
    cut = F.when((at_ > 0) & (at_ > dot), F.substring(last, F.lit(1), at_ - 1)).otherwise(last)
    from_url = F.when(cut == "", F.lit("image")).otherwise(cut)
    if disposition is None:
        return from_url
    given = F.trim(F.get(F.split(disposition, "filename=", -1), F.lit(1)), F.lit("\"'"))
    return F.when(given != "", given).otherwise(from_url)


def extension_of_type(content_type: Column) -> Column:
    """Extension of an image type written exactly so, else empty."""
    out = F.lit("")
    for kind, ext in EXTENSIONS.items():
        out = F.when(content_type == kind, ext).otherwise(out)
    return F.coalesce(out, F.lit(""))


def unique_name(name: Column, url: Column, content_type: Column | None = None) -> Column:
    """``base_<first 8 hex digits of the address's MD5>.ext``; a name without extension takes that of the content type."""
    ext = extension(name)
    base = F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ext))
    if content_type is not None:
        ext = F.when(ext == "", extension_of_type(content_type)).otherwise(ext)
    return F.concat(base, F.lit("_"), F.left(F.md5(url), F.lit(8)), ext)


def clean_name(name: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` only, runs of ``_`` joined and trimmed, at most 50 characters."""
    flat = F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9\-_]", "_"), "_+", "_")
    return F.left(F.trim(flat, F.lit("_")), F.lit(50))


def remote_key(path: Column, digest: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    ext = extension(name)
    return F.concat(clean_name(F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ext))), F.lit("_"), F.left(digest, F.lit(8)), ext)


def content_type(path: Column) -> Column:
    ext, out = F.lower(extension(path)), F.lit(DEFAULT_TYPE)
    for e, kind in CONTENT_TYPES.items():
        out = F.when(ext == e, kind).otherwise(out)
    return out


def local_path(url: Column, doc_path: Column) -> Column:
    """Absolute as it is, else joined to the document's folder and cleaned."""
    return F.when(F.startswith(url, F.lit("/")), url).otherwise(clean_path(F.concat(file_dir(doc_path), F.lit("/"), url)))


def _one_by_one(text: Column, pairs: Column) -> Column:
    """Each ``old`` replaced at its first occurrence in what the replacements before it left."""
    return F.aggregate(pairs, text, lambda t, p: replace_first(t, p["old"], p["new"]))


def _meet(m: Column, pattern: str) -> Column:
    """Whether a replacement may hit anything but its own reference: text that another one left, a reference within another, or an equal one that stays."""
    pairs, found = m["pairs"], m["found"]
    inner = lambda c: F.contains(F.substring(c, F.lit(2), F.char_length(c)), F.lit("!["))
    olds = F.transform(pairs, lambda p: p["old"])
    replaced = F.transform(pairs, lambda p: p["pos"])
    kept = F.array_except(F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>")), replaced)
    odd = F.exists(pairs, lambda p: ~F.startswith(p["new"], F.lit("![")) | ~F.endswith(p["new"], F.lit(")")) | inner(p["new"]) | ~F.coalesce(F.get(found, p["pos"]) == p["old"], F.lit(False)))
    again = F.arrays_overlap(F.transform(pairs, lambda p: F.regexp_extract(p["new"], pattern, 0)), olds)
    stays = F.arrays_overlap(F.transform(kept, lambda i: F.get(found, i)), olds)
    return F.coalesce(odd | F.exists(found, inner) | again | stays | (F.size(F.array_distinct(replaced)) < F.size(pairs)), F.lit(True))


def _spliced(m: Column) -> Column:
    """The text put together once, from what lies between replaced references and what they become."""
    pairs, pieces = m["pairs"], m["pieces"]
    own = lambda p: p["pos"] * 2 + 1  # index of a reference among the pieces
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(own(F.get(pairs, i - 1)) + 1)
    part = lambda a, b: F.array_join(F.slice(pieces, a + 1, b - a), "")
    done = F.transform(pairs, lambda p, i: F.concat(part(begin(i), own(p)), p["new"]))
    last = own(F.get(pairs, F.size(pairs) - 1)) + 1
    return F.concat(F.array_join(done, ""), part(last, F.size(pieces)))


def rewrite(docs: DataFrame, replacements: DataFrame, key: str = "doc_id", content: str = "content", pattern: str = REFERENCE) -> DataFrame:
    """``docs`` with each ``old`` replaced by ``new`` once, at its first occurrence, in order of ``pos``.

    ``replacements`` is ``key, pos, old, new``; ``pos`` counts the references that ``pattern`` finds.  Those are found once, and the text is put together once, in time that
    follows its length; only where a replacement could hit another's text are they made one by one.  Documents without any, and null texts, pass unchanged; of rows that
    repeat a position each is a replacement; of rows that repeat a key each is rewritten.
    """
    name = "pairs"
    while name in docs.columns:
        name += "_"
    order = F.struct(F.col("pos").cast("int").alias("pos"), "old", "new")
    folded = replacements.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias(name))
    text = F.col(content)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bound = F.struct(F.col(name).alias("pairs"), F.split(text, pattern, -1).alias("between"), found.alias("found"))
    whole = lambda m: F.struct(m["pairs"].alias("pairs"), m["found"].alias("found"), F.flatten(F.transform(m["between"], lambda b, i: F.array(b, F.coalesce(F.get(m["found"], i), F.lit(""))))).alias("pieces"))
    done = let(bound, lambda m: F.when(_meet(m, pattern), _one_by_one(text, m["pairs"])).otherwise(let(whole(m), _spliced)))
    return docs.join(folded, key, "left").withColumn(content, F.when(F.col(name).isNull() | text.isNull(), text).otherwise(done)).drop(name)


def export_paths(docs: DataFrame, manifest: DataFrame, cwd: str, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Local image references, where the file is in ``manifest`` (``path``), rewritten relative to ``cwd``; web ones are kept."""
    refs = references(docs, key, "path", content=content, pattern=EXPORT_REFERENCE).where(~F.col("url").rlike(r"\Ahttps?://"))
    found = refs.withColumn("_file", local_path(F.col("url"), F.col("path"))).join(manifest.select(F.col("path").alias("_file")).distinct(), "_file", "left_semi")
    new = F.concat(F.lit("!["), F.col("alt"), F.lit("]("), relative_path(F.col("_file"), F.lit(cwd)), F.lit(")"))
    return rewrite(docs, found.select(key, "pos", F.col("full_match").alias("old"), new.alias("new")), key, content, EXPORT_REFERENCE)
