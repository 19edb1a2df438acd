"""Packing by power-of-two decomposition.

Every document's ids are cut, largest piece first, into pieces whose lengths are powers of two: as
many of the full sequence length as fit, then the binary digits of the rest.  A piece is a sequence
of its own, so no sequence crosses documents and none needs padding; sequences of one length form a
bucket (column ``length``), from which batches of equal shape are drawn.

The operator is one narrow pass: no shuffle, no state across rows, and a lost task is redone alone.

Defined cases: null text counts as empty, and an empty document is its end id alone; rows that repeat
a ``doc_id`` are packed each; a null ``doc_id`` stays null; an empty table gives no pieces; columns
other than the two named are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.tokens import encoder, public_path

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=65_536)
def piece_lengths(n: int, longest: int) -> tuple[int, ...]:
    """Powers of two that add up to ``n``, none above ``longest`` (itself a power of two), in falling order."""
    rest = n % longest
    return (longest,) * (n // longest) + tuple(1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, longest: int = 2048) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and places in sequences.

    ``sequence_id`` is the task's partition number times 2**40 plus a count within it: distinct, and the
    same whenever the same table is read with the same splits.  ``offset`` is the place in the sequence.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    path = tokenizer or public_path()

    def run(batches):
        import pyarrow as pa

        encode, base, n_seq = encoder(path, end_id).encode, TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                docs_, starts, sizes, ids, totals = [], [], [], [], []
                for doc, own in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    n, at = len(own) // 4, 0
                    cuts = piece_lengths(n, longest)
                    docs_ += [doc] * len(cuts)
                    totals += [n] * len(cuts)
                    sizes += cuts
                    for size in cuts:
                        starts.append(at)
                        ids.append(own[4 * at : 4 * (at + size)])
                        at += size
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64()), pa.array(range(base + n_seq, base + n_seq + k), pa.int64()), pa.array([0] * k, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
                n_seq += k

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences, one folder for each length, so that a reader takes batches of one shape."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
