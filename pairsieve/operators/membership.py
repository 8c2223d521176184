"""Which rows belong to a stored set of keys, without a shuffle of the rows: bitmaps of the set by ranges of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Bitmaps of 4 KB each that are broadcast at most (64 MB); each covers 32,768 consecutive keys.
BROADCAST_BUCKETS = 16_384


def build_bitmaps(members: DataFrame, key: str = "example_num") -> DataFrame:
    """``bucket, bits``: the distinct keys of ``members``, integers, as a bitmap per range of 32,768 keys. NULL keys are in no set."""
    known = members.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"))
    bucket = F.bitmap_bucket_number("k").alias("bucket")
    return known.groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits"))


def _has_bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1


def flag_by_bitmaps(df: DataFrame, bitmaps: DataFrame, key: str = "example_num", name: str = "is_member") -> DataFrame:
    """``df`` with a boolean: is the row's key in the set? A NULL key is not.

    The number of bitmaps is looked at first. Up to ``BROADCAST_BUCKETS`` (half a billion keys where keys are dense) they are
    broadcast and ``df`` stays where it is. Beyond that, as for few keys spread over a wide range, the bitmaps are turned into
    keys again and joined as Spark sees fit. The result is the same.
    """
    held = materialise(bitmaps, "bitmaps")
    position = F.bitmap_bit_position(F.col(key).cast("long"))
    if held.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS:
        small = F.broadcast(held.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
        placed = df.withColumn("_bucket", F.bitmap_bucket_number(F.col(key).cast("long")))
        flagged = placed.join(small, "_bucket", "left").withColumn(name, F.coalesce(_has_bit(F.col("_bits"), position), F.lit(False)))
        return flagged.select(*df.columns, name)
    marked = bitmap_keys(held, "_key").withColumn(name, F.lit(True))
    joined = df.join(marked, F.col(key).cast("long") == F.col("_key"), "left")
    return joined.select(*df.columns, F.coalesce(name, F.lit(False)).alias(name))


def bitmap_keys(bitmaps: DataFrame, key: str = "example_num") -> DataFrame:
    """The keys of a set, ascending from none to all of 32,768 per bitmap."""
    places = bitmaps.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(32_767))).alias("place"))
    # Buckets above 0 hold positive keys upwards, the others keys from 0 downwards.
    own = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32_768 + F.col("place") + 1).otherwise(
        F.col("bucket") * 32_768 - F.col("place")
    )
    return places.where(_has_bit(F.col("bits"), F.col("place"))).select(own.cast("long").alias(key))
