"""How the sources of each language differ in their words, by SQL over shards.

Terms are runs of ASCII letters and of characters beyond ASCII, with A to Z lowered.  Tasks count them where texts lie and add their counts up before anything travels.  Counts are
then dealt to shards by a hash of language and term, so a shard has all there is on its terms, and DuckDB works on a shard at a time: it adds counts up, keeps the terms
that enough documents of the language hold, and, once Spark has added up the totals of groups, makes partial sums for pairs of sources and the
first terms of each group.  Spark merges the sums and the rankings.

With ``p = 1 + floor(SCALE (count + 1) / (N + V))`` in a group and ``f(p, q) = floor((p - q)^2 / q)``, a pair's value is the sum of ``f`` over all V kept terms of the language.  A term
that neither source holds gives the same ``f`` whatever the term, and one that only one holds depends on that source's ``p`` alone.  So a shard joins only sources that
share a term, for the difference that this makes, and counts each group's terms by ``p``; the rest is arithmetic on groups.  All of it is in whole numbers.

Defined cases: null text, language and source count as empty ones; every row of the table is a document (ids are not looked at, so repeated rows count as often as they
occur); groups and languages without terms keep their pairs, with value 0 if the language keeps no term; a language with one source has no pairs; ties rank by
the item's UTF-8 bytes; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.scratch import Scratch, partitions

#: Documents of a language that hold a kept term, the scale of relative frequencies, ranks of the term part.
LEAST_DOCS, SCALE, RANKS = 3, 1_000_000_000, 200
#: Bytes of text looked at at once, counts gathered in a task before they are added up, and rows of a shard.
PIECE, GATHERED, SHARD = 4 << 20, 400_000, 2_000_000
#: Parts in which a group's shares of the shards' first terms are ranked before they meet.
SALT = 32

#: What byte each byte of a term becomes; 0 for those between terms.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number and term of every occurrence in these texts (none of them null)."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts = ends[:-1] - ends[0]
    low = _FOLD[raw]
    inside = low > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = starts[starts < len(raw)]
    first[heads] = inside[heads]
    at = np.flatnonzero(first)
    kept = low[inside]
    offsets = np.append((np.cumsum(inside, dtype=np.int64)[at] - 1), len(kept))
    found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(kept))
    return (np.searchsorted(starts, at, side="right") - 1).astype(np.int32), found


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``PIECE`` bytes of text; a longer text is one of its own."""
    sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(sizes // PIECE, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _duck():
    """A DuckDB of one thread in this task."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": "", "preserve_insertion_order": False})


def _batches(duck, sql: str) -> Iterator[pa.RecordBatch]:
    reader = duck.sql(sql).to_arrow_reader(65_536)
    names = reader.schema.names
    for batch in reader:
        yield pa.RecordBatch.from_arrays(batch.columns, names=names)


COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of a term in a group and documents that hold it, added up as far as ``GATHERED`` rows allow."""
    duck = _duck()
    duck.execute("CREATE TABLE gathered (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    total = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM gathered GROUP BY ALL"
    size = lambda: duck.execute("SELECT count(*) FROM gathered").fetchall()[0][0]
    for batch in batches:
        for piece in _pieces(batch):
            row, term = terms(piece.column(2))
            duck.register("found", pa.table({"row": row, "term": term}))
            duck.register("place", pa.table({"row": pa.array(np.arange(piece.num_rows, dtype=np.int32)), "lang": piece.column(0), "source": piece.column(1)}))
            duck.execute("INSERT INTO gathered SELECT lang, source, term, sum(c), count(*) FROM (SELECT row, term, count(*) AS c FROM found GROUP BY ALL) JOIN place USING (row) GROUP BY ALL")
            if size() > GATHERED:
                duck.execute(f"CREATE OR REPLACE TABLE less AS {total}")
                duck.execute("DROP TABLE gathered")
                duck.execute("ALTER TABLE less RENAME TO gathered")
                if size() > GATHERED // 2:
                    yield from _batches(duck, "SELECT * FROM gathered")
                    duck.execute("DELETE FROM gathered")
    yield from _batches(duck, total)


def _loaded(batches: Iterator[pa.RecordBatch], columns: str):
    """A DuckDB that holds the rows of a shard as ``shard``."""
    duck = _duck()
    duck.execute(f"CREATE TABLE shard ({columns})")
    for batch in batches:
        duck.register("batch", pa.Table.from_batches([batch]))
        duck.execute("INSERT INTO shard SELECT * FROM batch")
    return duck


KEPT = "lang string, source string, term string, n long, total long, head int"


def _keep(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of kept terms with the language's; ``head`` is 1 in one row of each term."""
        duck = _loaded(batches, "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT")
        yield from _batches(duck, f"""
            SELECT lang, source, term, n, total, (source = lowest)::INT AS head
            FROM (SELECT lang, source, term, sum(n)::BIGINT AS n FROM shard GROUP BY ALL)
            JOIN (SELECT lang, term, sum(n)::BIGINT AS total, min(source) AS lowest FROM shard GROUP BY ALL HAVING sum(docs) >= {least}) USING (lang, term)""")

    return run


SUMS = "kind string, lang string, source string, item string, p long, value decimal(38,0)"


def _sums(ranks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``both``: by pair, what shared terms add to the sums of terms as if unshared; ``alone``: by group and p the number of terms; ``term``: the first terms of each group."""
        duck = _loaded(batches, "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, total BIGINT, group_n BIGINT, lang_n BIGINT, kept BIGINT, p0 BIGINT")
        duck.execute("CREATE MACRO f(p, q) AS (p - q) * (p - q) // q")
        duck.execute(f"CREATE MACRO part(n, whole, kept) AS (1 + {SCALE}::HUGEINT * (n + 1) // (whole + kept))::BIGINT")
        duck.execute("CREATE TABLE w AS SELECT lang, source, term, p0, part(n, group_n, kept) AS p, part(total, lang_n, kept) AS q FROM shard")
        yield from _batches(duck, """
            SELECT 'both' AS kind, lang, a.source AS source, b.source AS item, NULL::BIGINT AS p, sum((f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::HUGEINT)::DECIMAL(38, 0) AS value
            FROM w a JOIN w b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL""")
        yield from _batches(duck, "SELECT 'alone' AS kind, lang, source, NULL::VARCHAR AS item, p, count(*)::DECIMAL(38, 0) AS value FROM w GROUP BY ALL")
        yield from _batches(duck, f"""
            SELECT 'term' AS kind, lang, source, term AS item, NULL::BIGINT AS p, f(p, q)::DECIMAL(38, 0) AS value FROM w WHERE p > q
            QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {ranks}""")

    return run


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}").cast("decimal(19,0)")


def _shards(spark, rows: int) -> int:
    return max(partitions(spark), -(-rows // SHARD))


def _by_value() -> list[Column]:
    return [F.col("value").desc(), F.col("item").asc()]


def pair_values(groups: DataFrame, sums: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of ordered pairs of a language's sources."""
    a = groups.select("lang", "source", "kept", "p0", "held")
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("other_held"))
    rest = (F.col("kept") - F.col("held") - F.col("other_held")).cast("decimal(19,0)")
    neither = a.join(b, "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("kept") > 0, rest * _f("p0", "q0")).otherwise(F.lit(0)).cast("decimal(38,0)").alias("value"))
    alone = sums.where("kind = 'alone'").groupBy("lang", "source", "p").agg(F.sum("value").cast("decimal(19,0)").alias("m"))
    one = alone.join(b.drop("other_held"), "lang").where("source <> item").select("lang", F.explode(F.array(
        F.struct("source", "item", (F.col("m") * _f("p", "q0")).cast("decimal(38,0)").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * _f("q0", "p")).cast("decimal(38,0)").alias("value")),
    )).alias("x")).select("lang", "x.*")
    both = sums.where("kind = 'both'").select("lang", "source", "item", "value")
    return neither.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def first_terms(sums: DataFrame, ranks: int) -> DataFrame:
    """``lang, source, item, value, rank`` of the first terms of each group, ranked in parts first."""
    found = sums.where("kind = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    for part in ([F.pmod(F.xxhash64("item"), F.lit(SALT))], []):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", *part).orderBy(*_by_value()))).where(F.col("rank") <= ranks)
    return found


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and the terms that set it apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counts = scratch.keep(docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(_count, COUNTS), "counts")
    kept = scratch.keep(counts.repartition(_shards(spark, counts.count()), "lang", "term").mapInArrow(_keep(least_docs), KEPT), "kept")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("head").alias("kept"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("held"))
    every = docs.select(blank("lang"), blank("source")).distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0)
    p0 = F.when(F.col("kept") > 0, F.lit(1) + F.expr(f"{SCALE} div (group_n + kept)"))
    groups = scratch.keep(every.withColumn("p0", p0), "groups")  # written, so that Spark knows its size when it joins: sent to all tasks if small, else shuffled
    placed = kept.join(groups.drop("held"), ["lang", "source"]).select("lang", "source", "term", "n", "total", "group_n", "lang_n", "kept", "p0")
    sums = scratch.keep(placed.repartition(_shards(spark, kept.count()), "lang", "term").mapInArrow(_sums(ranks), SUMS), "sums")
    pairs = pair_values(groups, sums).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*_by_value())))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(first_terms(sums, ranks), "term"))
