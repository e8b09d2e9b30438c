"""Bounded training samples of labelled documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text modulo n; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, columns: list[str]) -> pd.DataFrame:
    """At most ``bound`` labelled rows of docs, those with the least hash of doc_id, sorted by it.

    The bound is on what reaches the driver; the labels are cut to it before they meet the texts.
    """
    wanted = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    wanted = wanted.withColumn("__bf_r", F.xxhash64("doc_id", F.lit(8))).orderBy("__bf_r", "doc_id").limit(bound)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", *columns).join(F.broadcast(wanted), "doc_id")
    return rows.dropDuplicates(["doc_id"]).toPandas().sort_values(["__bf_r", "doc_id"]).drop(columns="__bf_r").reset_index(drop=True)
