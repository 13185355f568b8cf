"""A runtime filter from keys: rows whose key cannot be wanted go before anything is shuffled.

The wanted keys are hashed into a Bloom filter of a fixed number of bits (one
hash function), kept as Spark bitmaps of BLOCK_BITS bits each. Its size is a
parameter and does not grow with the data, so it may be broadcast: a probe is
a broadcast join on the bitmap's number and one bit test. Rows that pass may
still be unwanted (with probability wanted keys / bits at most), so an exact
join follows; no wanted row is lost, however full the filter is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's bitmap functions.
BLOCK_BITS = 8 * 4096
#: Bitmaps of a filter: 2**11 of 4 KiB are 8 MiB, for some million wanted keys.
BLOCKS = 1 << 11


def _place(keys: list[Column], blocks: int) -> tuple[Column, Column]:
    """Number of the bitmap and bit in it for a key."""
    # Never null, and known not to be: else the join tests it for null first, and works out the keys twice.
    at = F.coalesce(F.pmod(F.xxhash64(*keys), F.lit(blocks * BLOCK_BITS)), F.lit(0))
    return F.shiftright(at, BLOCK_BITS.bit_length() - 1).cast("int"), at.bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")


def key_filter(wanted: DataFrame, keys: list[str], blocks: int = BLOCKS) -> DataFrame:
    """The filter of the distinct keys of ``wanted``: at most ``blocks`` rows (filter_block, filter_bits).
    Built by a partly aggregated group-by, one partial bitmap of each block from each task."""
    block, bit = _place([F.col(k) for k in keys], blocks)
    return (wanted.dropna("all", subset=keys).select(block.alias("filter_block"), bit.cast("long").alias("filter_bit"))
            .groupBy("filter_block").agg(F.bitmap_construct_agg("filter_bit").alias("filter_bits")))


def may_match(rows: DataFrame, keys: list[str], wanted: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The rows whose ``keys`` may be in the filter ``wanted`` (from :func:`key_filter`, the same ``blocks``)."""
    block, bit = _place([F.col(k) for k in keys], blocks)
    probed = rows.withColumn("_filter_probe", block).withColumn("_filter_bit", bit)
    return (probed.join(F.broadcast(wanted), F.col("_filter_probe") == F.col("filter_block"))  # at most blocks * 4 KiB
            .where(_is_set()).select(*[F.col(f"`{c}`") for c in rows.columns]))


def _is_set() -> Column:
    byte = F.expr("cast(conv(hex(substring(filter_bits, _filter_bit div 8 + 1, 1)), 16, 10) as int)")
    return F.getbit(byte, F.col("_filter_bit") % 8) == 1


def groups_that_may_hold(rows: DataFrame, keys: list[str], filters: DataFrame, group: str, blocks: int) -> DataFrame:
    """The values of ``group`` whose filter (rows of ``filters``: ``group``, filter_block, filter_bits; any number
    of them for each) may hold the key of some row. No group that does is left out."""
    block, bit = _place([F.col(k) for k in keys], blocks)
    probes = rows.select(block.alias("_filter_probe"), bit.alias("_filter_bit")).distinct()
    return (probes.join(filters, F.col("_filter_probe") == F.col("filter_block")).where(_is_set()).select(group).distinct())
