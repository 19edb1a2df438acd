"""From raw documents to packed training sequences, each stage one operator of ``folio.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again for the
next one.  All stages but the last return the columns of ``documents``; further columns, whatever their names, are carried along.

Defined cases: null text is a document without text, which the quality stage rejects, so no later stage of ``run`` meets one (called by itself each stage
takes them as its operator says); a null ``doc_id`` is larger than any other, so of equal or near texts the row with an id stays; a null language or source is
one of its own; rows that repeat id and text are one document from the second stage on; an empty table gives an empty result of the same columns;
documents with fewer than five words are near copies only of the same sequence of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import dedup, jaccard, kneser_ney, mixing, packing
from folio.llm.queries import trusted_ids
from folio.llm.scratch import Scratch, bounded_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text does not reject."""
    bounded_batches(spark)
    rows = docs.select("doc_id", "lang", "text", F.struct("*").alias("row"))
    return kneser_ney.classify(rows, trusted_ids(spark, sf_dir), carry=("row",)).where("kept").select("carried_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    bounded_batches(spark)
    return dedup.one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bounded_batches(spark)
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    bounded_batches(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their ids."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("jaccard_join", near), ("mix_sources", mix), ("packing", pack)]

#: A language model's thresholds and shingle components are beyond SQL; the stages and their chain are tested against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}_{name}")
    return docs
