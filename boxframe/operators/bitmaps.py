"""Sets of small integers as bitmaps in buckets of 32,768, by Spark's own bitmap aggregates.

A set is rows of (key, bucket, bits). Bits are kept without trailing zero bytes, so a set of low ordinals takes a
few bytes; aggregates take bitmaps of any length. Integers are shifted by one, so that 0 falls into the first bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a bucket, and bytes of a full bitmap: fixed by the aggregates.
BUCKET, BYTES = 32_768, 4_096


def build(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, bucket, bits: the sets of value (0 or more) for each key."""
    n = F.col(value).cast("long") + 1
    at = F.bitmap_bit_position(n)
    sets = rows.groupBy(*key, F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bits"), F.max(at).alias("__last"))
    return sets.withColumn("bits", F.substring("bits", F.lit(1), (F.floor(F.col("__last") / 8) + 1).cast("int"))).drop("__last")


def whole(bits: Column) -> Column:
    """bits with their trailing zero bytes."""
    return F.rpad(bits, F.lit(BYTES), F.lit(b"\x00"))


def trimmed(bits: Column) -> Column:
    """bits without their trailing zero bytes."""
    return F.unhex(F.regexp_replace(F.hex(bits), "(00)+$", ""))


def union(sets: DataFrame, key: list[str]) -> DataFrame:
    """The union of sets by a coarser key."""
    return sets.groupBy(*key, "bucket").agg(F.bitmap_or_agg(whole(F.col("bits"))).alias("bits")).withColumn("bits", trimmed(F.col("bits")))


def cardinality(sets: DataFrame, key: list[str]) -> DataFrame:
    return sets.groupBy(*key).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def contains(bits: Column, value: Column) -> Column:
    """Whether bits of a bucket hold a value of that bucket."""
    at = F.pmod(value.cast("long"), F.lit(BUCKET))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def values(bits: Column, bucket: Column) -> Column:
    """The sorted values of a bucket's bits."""
    base = (bucket - 1) * BUCKET
    each = F.transform(F.sequence(F.lit(0), F.octet_length(bits) * 8 - 1), lambda i: F.when(contains(bits, i), base + i))
    return F.filter(each, lambda v: v.isNotNull())


def intersections(left: DataFrame, right: DataFrame, left_key: list[str], right_key: list[str], condition: Column | None = None) -> DataFrame:
    """left_key, right_key, n: the size of every intersection that is not empty.

    Sets meet by bucket. Each pair of bitmaps becomes two rows of one key, which are combined where they are made, before the shuffle.
    """
    a = left.select(*left_key, "bucket", F.col("bits").alias("__a"))
    b = right.select(*right_key, "bucket", F.col("bits").alias("__b"))
    pairs = a.join(b, "bucket")
    pairs = pairs if condition is None else pairs.where(condition)
    key = [*left_key, *right_key]
    both = pairs.select(*key, "bucket", F.explode(F.array(whole(F.col("__a")), whole(F.col("__b")))).alias("bits"))
    shared = both.groupBy(*key, "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return shared.groupBy(*key).agg(F.sum("n").alias("n")).where("n > 0")
