"""The latest state of every node of a feed, kept by micro-batches as versions of a bucketed table.

A node's bucket is a hash of its key. A micro-batch reads the buckets that it touches, as they were before it, merges its rows by
(time, tie), and writes those buckets under its own number. Writing a number again, after a lost driver, overwrites the same
folder with the same rows, and a folder without its success mark is not there: so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import exists, folders

BUCKETS = 64
#: Names of the folders, and columns that no feed may have.
VERSION, BUCKET = "bf_version", "bf_bucket"


def _versions(spark: SparkSession, folder: str, below: int | None = None) -> list[int]:
    found = [int(n.removeprefix(f"{VERSION}=")) for n in folders(spark, folder) if n.startswith(f"{VERSION}=")]
    return sorted(v for v in found if (below is None or v < below) and exists(spark, f"{folder}/{VERSION}={v}/_SUCCESS"))


def current(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """The newest rows of every bucket, of versions below a number; None before the first batch."""
    versions = _versions(spark, folder, below)
    if not versions:
        return None
    rows = spark.read.option("basePath", folder).parquet(*[f"{folder}/{VERSION}={v}" for v in versions])
    # One row for each bucket: a proven bound.
    newest = F.broadcast(rows.groupBy(BUCKET).agg(F.max(VERSION).alias(VERSION)))
    return rows.join(newest, [BUCKET, VERSION])


def merge(batch: DataFrame, number: int, folder: str, key: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Merges a micro-batch into the table; of a node's rows the greatest by order stays. Rows with equal order are the same row."""
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in key]
    rows = batch.withColumn(BUCKET, _bucket(key, buckets))
    before = current(spark, folder, number)
    if before is not None:
        touched = F.broadcast(rows.select(BUCKET).distinct())  # at most `buckets` rows
        rows = rows.unionByName(before.drop(VERSION).join(touched, BUCKET, "left_semi"))
    best = rows.groupBy(BUCKET, *key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("best"))
    best = best.select(BUCKET, *key, *[F.col(f"best.{c}").alias(c) for c in rest])
    best.select(*batch.columns, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{folder}/{VERSION}={number}")


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
