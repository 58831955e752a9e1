"""A blocked Bloom filter built and probed inside Spark SQL.

The filter is a table of at most ``MAX_BLOCKS`` rows of 4 KB (``bitmap_construct_agg``): a key belongs to
one block and sets a few bits of it. Its size is therefore bounded whatever the number of keys, so it
may be broadcast; with more keys it only answers "maybe" more often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
MAX_BLOCKS = 2_048
HASHES = 6
BITS_PER_KEY = 12


def _positions(key: Column, hashes: int) -> Column:
    a, b = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    return F.array(*[F.pmod(a.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(i) * (b.bitwiseAND(F.lit(0xFFFFFF)) * 2 + 1), F.lit(BLOCK_BITS)) for i in range(hashes)])


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


class BloomFilter:
    """Filter over the non-null values of column ``key`` of ``keys``."""

    def __init__(self, keys: DataFrame, key: str = "key", n_keys: int | None = None, max_blocks: int = MAX_BLOCKS) -> None:
        own = keys.select(F.col(key).alias("_key")).where("_key is not null")
        n = own.count() if n_keys is None else n_keys
        self.blocks = max(1, min(max_blocks, -(-n * BITS_PER_KEY // BLOCK_BITS)))
        self.table = (
            own.select(_block(F.col("_key"), self.blocks).alias("_block"), F.explode(_positions(F.col("_key"), HASHES)).alias("_bit"))
            .groupBy("_block")
            .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
        )

    def probe(self, df: DataFrame, key: str = "key", flag: str = "maybe") -> DataFrame:
        """``df`` with boolean ``flag``: False proves that the key is not in the filter (null: False)."""

        def is_set(bit: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))) % 2 == 1

        hit = df.withColumn("_block", _block(F.col(key), self.blocks)).join(F.broadcast(self.table), "_block", "left")
        maybe = F.col(key).isNotNull() & F.col("_bits").isNotNull() & F.forall(_positions(F.col(key), HASHES), is_set)
        return hit.withColumn(flag, F.coalesce(maybe, F.lit(False))).drop("_block", "_bits")
