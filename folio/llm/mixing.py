"""Mixing sources to target weights by Pareto order sampling.

A source's share of the target is its weight's share of all weights; no source may exceed ``ceiling`` times its own
size, and what it cannot take is shared again by weight among the others.  A document's expected number of copies is the
target over the source's size (times its own ``weight``, if one is given, capped at ``ceiling``).  Its whole part
is allocated for certain.  The rest is its inclusion probability ``p``: documents are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` from a hash of the document's key, and the first are taken until the
source's words are reached; the gap below the target that is then open is closed by the one other document whose size
is nearest to it.

Sources are ordered in one task, a row for each (their names, not their documents), so they should be thousands or millions, not as many as documents.
The cut is found without ordering a source in one task: rank scores are summed in ``bins`` equal intervals (partial
sums on each task), and only the documents of the interval in which the target falls are ordered.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a null key hashes as the
word ``null``; rows alike in key, source, size and weight are separate documents told apart by a count from 0 (``copy_no``),
which enters the hash; an empty table gives an empty result; sources of size 0 have target 0; columns of the input other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
BINS = 16_384
#: Sources up to which their table is sent to every task; beyond it the join is a shuffled one.
FEW = 10_000


def word_count(text: Column) -> Column:
    """Number of maximal runs outside ``[\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, copy_no: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed, key and count."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), copy_no.cast("string"))), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights=WEIGHTS, ceiling: float = 3.0) -> DataFrame:
    """``source, source_size`` with ``target`` and ``capped``.  Equal to sharing again and again: with sources in order of the
    level at which they are full, those before the first that is not full at the level of the rest are full."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_level = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("full_at", F.lit(float(ceiling)) * F.col("source_size") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("total_w", F.sum("w").over(everything))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(by_level), F.lit(0)).cast("double"))
        .withColumn("w_before", F.coalesce(F.sum("w").over(by_level), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.lit(float(ceiling)) * F.col("size_before")) / (F.col("total_w") - F.col("w_before")))
        .withColumn("final", -F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", (-F.col("level")).alias("fall")))).over(everything)["fall"])
    )
    capped = F.col("final").isNull() | (F.col("full_at") <= F.col("final"))
    return levels.select("source", "source_size", F.when(capped, F.lit(float(ceiling)) * F.col("source_size")).otherwise(F.col("final") * F.col("w")).alias("target"), capped.alias("capped"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights=WEIGHTS, ceiling: int = 3, seed: str = "mix", bins: int = BINS, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, source, size, copy_no, source_size, target, copies, taken``, a row for each document.

    With ``weight_col`` (null or negative: 0) expected copies are ``min(ceiling, c * weight)``, one ``c`` for a source from two
    rounds of rescaling; a source whose weights cannot reach its target takes what they allow.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), weight.alias("weight"))
    alike = bare.groupBy("doc_id", "source", "size", "weight").agg(F.count(F.lit(1)).alias("n"))
    sized = scratch.keep(alike.withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n"), "sized")
    sources = scratch.keep(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ceiling), "sources")
    few = sources.limit(FEW + 1).count() <= FEW

    def of_source(left: DataFrame, right: DataFrame) -> DataFrame:
        """Left join on source, null equal to null."""
        right = right.withColumnRenamed("source", "own_source")
        return left.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("own_source")), "left").drop("own_source")

    rows = of_source(sized, sources)
    if weight_col is None:
        rows = rows.withColumn("expected", F.when(F.col("capped"), F.lit(float(ceiling))).otherwise(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    else:
        rows = rows.withColumn("expected", F.lit(0.0))
        for _ in range(8):  # what full documents cannot take goes to the others
            full = F.col("expected") >= ceiling
            need = rows.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.when(full, F.col("size") * F.lit(float(ceiling))).otherwise(0.0)).alias("got"), F.sum(F.when(~full, F.col("size") * F.col("weight")).otherwise(0.0)).alias("mass"))
            scale = need.select("source", F.when(F.col("mass") > 0, F.greatest(F.col("t") - F.col("got"), F.lit(0.0)) / F.col("mass")).otherwise(0.0).alias("scale"))
            rows = of_source(rows, scale).withColumn("expected", F.when(full, F.lit(float(ceiling))).otherwise(F.least(F.lit(float(ceiling)), F.col("scale") * F.col("weight")))).drop("scale")
            rows = scratch.keep(rows, f"expected{_}")
    p, u = F.col("expected") - F.col("whole"), F.col("u")
    scored = (
        rows.withColumn("whole", F.floor("expected"))
        .withColumn("p", p)
        .withColumn("u", uniform(F.col("doc_id"), F.col("copy_no"), seed))
        .withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * bins))
    )
    per_bin = scored.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.sum(F.col("size") * F.col("whole")).alias("certain"), F.first("target").alias("t"))
    per_bin = scratch.keep(per_bin, "bins")
    certain = per_bin.groupBy("source").agg((F.first("t") - F.sum("certain")).alias("budget"))
    # the bins of a source are few; running sums over them give the bin in which its budget ends
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = of_source(per_bin.where(F.col("bin").isNotNull()).withColumn("upto", F.sum("bin_size").over(running)), certain)
    cut = cut.where(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("below"), "budget")).alias("c"))
    cut = scratch.keep(cut.select("source", F.col("c.bin").alias("cut_bin"), F.col("c.below").alias("below"), F.col("c.budget").alias("budget")), "cut")
    at_cut = of_source(scored, cut)
    inside = Window.partitionBy("source").orderBy("q", "doc_id", "size", "copy_no").rowsBetween(Window.unboundedPreceding, 0)
    edge = at_cut.where(F.col("bin") == F.col("cut_bin")).withColumn("sum", F.col("below") + F.sum("size").over(inside))
    first_over = edge.where(F.col("sum") > F.col("budget")).groupBy("source").agg(F.min(F.struct("q", "doc_id", "size", "copy_no", (F.col("sum") - F.col("size")).alias("before"), "budget")).alias("f"))
    first_over = scratch.keep(first_over.select("source", F.struct("f.q", "f.doc_id", "f.size", "f.copy_no").alias("first_over"), (F.col("f.budget") - F.col("f.before")).alias("gap")), "over")
    ranked = of_source(scored, first_over).withColumn("place", F.struct("q", "doc_id", "size", "copy_no"))
    chosen = F.col("q").isNotNull() & (F.col("first_over").isNull() | (F.col("place") < F.col("first_over")))
    off = F.abs(F.col("size") - F.col("gap"))
    closer = ranked.where(F.col("q").isNotNull() & ~chosen & (F.col("size") > 0) & (off < F.col("gap"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "place")).alias("c"))
    closer = scratch.keep(closer.select("source", F.col("c.place").alias("closing")), "close")
    done = of_source(ranked, closer)
    is_close = F.coalesce(F.col("closing").isNotNull() & F.col("place").eqNullSafe(F.col("closing")), F.lit(False))
    copies = F.col("whole") + F.when(chosen | is_close, 1).otherwise(0)
    return done.select("doc_id", "source", "size", "copy_no", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; its columns may have any names.

    Rows alike in id, source and size have the same whole copies; if only some of them are chosen for one more, these are the first by
    a hash of the text.  The numbering stands on the shuffle of the join, so texts are shuffled once.
    """

    def keyed(c: str, none) -> list[Column]:
        return [F.coalesce(F.col(c), F.lit(none)).alias(f"key_{c}"), F.col(c).isNull().alias(f"no_{c}")]

    keys = ["key_id", "no_id", "key_source", "no_source", "size"]
    plan = mix(docs, id_col, text_col, source_col, scratch=scratch, **options).withColumnRenamed("doc_id", "id")
    plan = plan.select(*keyed("id", 0), *keyed("source", ""), "size", "copies").groupBy(*keys).agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows")).where("all > 0")
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("mark"))
    own = own.select("row", *keyed("id", 0), *keyed("source", ""), "size", "mark").join(plan.hint("merge"), keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("mark"))
    copies = F.col("least") + F.when(place <= F.col("all") - F.col("rows") * F.col("least"), 1).otherwise(0)
    return own.withColumn("copies", copies).where("copies > 0").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
