"""A screen of fixed size before a shuffled join by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the screen: 8 MB, whatever the number of ids.
SCREEN = 1 << 26


def screened(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc_id`` is not among ``ids``: a bit map of fixed size is sent to all tasks.

    All wanted rows pass; the more ids there are, the more others pass too, until nothing is held back.
    """
    spot = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(SCREEN))
    bits = ids.select(spot().alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    place = F.bitmap_bit_position(spot())
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(spot()) == F.col("bucket")).where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("bits", "bucket")
