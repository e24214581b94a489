"""Keys as bits of a small table that every task gets: most rows without a partner go unshuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.durable import written

#: Bits a key has at least, so that of the other rows one in so many is let through.
BITS_PER_KEY = 64
#: Bits at most, 32 MB wherever the sieve is sent; with more keys it lets more through.
MOST_BITS = 1 << 28
_LEAST_BITS = 1 << 15


class Sieve:
    """The keys of some rows, hashed. A row whose keys it hasn't is surely none of them."""

    def __init__(self, members: DataFrame, keys: Sequence[str]) -> None:
        self.keys = tuple(keys)
        self.size = _LEAST_BITS
        while self.size < min(MOST_BITS, members.count() * BITS_PER_KEY):
            self.size *= 2
        place = members.select(self._place().alias("_place"))
        spread = place.select(
            F.bitmap_bucket_number("_place").alias("_bucket"), F.bitmap_bit_position("_place").alias("_bit")
        ).repartition("_bucket")  # keys move once, not a bitmap from each task
        bitmaps = spread.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
        self._bitmaps = written(bitmaps, "sieve")

    def _place(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.size)) + 1

    def marked(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows with a column that is false where their keys are surely no member's."""
        bit = F.bitmap_bit_position(self._place())
        byte = F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))
        held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (bit % 8).cast("int")) == 1
        found = rows.withColumn("_bucket", F.bitmap_bucket_number(self._place())).join(
            F.broadcast(self._bitmaps), "_bucket", "left"
        )
        return found.select(*rows.columns, F.coalesce(held, F.lit(False)).alias(name))
