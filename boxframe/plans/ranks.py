"""Running sums and neighbours in a global order, without one task that sees a whole group.

Rows are dealt to range partitions, which follow one another in the order; windows work within a partition, and one row for each
partition and group carries sums or last values over to the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

PART = "__part"


def dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df as a stored table with __part, its range partition by group and order."""
    return stored(df.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()), "dealt")


def running(df: DataFrame, by: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """df with name: the sum of amount over the rows of its group that come before it. Order must tell rows of a group apart."""
    rows = dealt(df.withColumn("__amount", amount), by, order)
    before = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition that a group reaches: groups and partitions at most, whatever a group holds.
    ends = rows.groupBy(*by, PART).agg(F.sum("__amount").alias("__sum"))
    carried = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carried", F.coalesce(F.sum("__sum").over(carried), F.lit(0))).drop("__sum")
    rows = rows.withColumn(name, F.coalesce(F.sum("__amount").over(before), F.lit(0))).drop("__amount")
    return _same(rows, ends, by).withColumn(name, F.col(name) + F.col("__carried")).drop("__carried", PART)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with name: its place in the global order, from start. Order must tell rows apart."""
    return running(df, [], order, F.lit(1), name).withColumn(name, (F.col(name) + start).cast("long"))


def lagged(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with name: value of the row before it in its group."""
    rows = dealt(df, by, order)
    ends = rows.groupBy(*by, PART).agg(F.max_by(F.struct(value), F.struct(*order)).alias("__end"))
    carried = ends.withColumn("__carried", F.lag("__end").over(Window.partitionBy(*by).orderBy(PART))).drop("__end")
    first = F.row_number().over(Window.partitionBy(PART, *by).orderBy(*order)) == 1
    rows = rows.withColumns({"__first": first, name: F.lag(value).over(Window.partitionBy(PART, *by).orderBy(*order))})
    return _same(rows, carried, by).withColumn(name, F.when(F.col("__first"), F.col(f"__carried.{value}")).otherwise(F.col(name))).drop("__first", "__carried", PART)


def _same(rows: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """rows joined with the row of their group and partition; groups may be null."""
    ends = ends.withColumnsRenamed({c: f"__e_{c}" for c in [*by, PART]})
    on = [F.col(c).eqNullSafe(F.col(f"__e_{c}")) for c in by] + [F.col(PART) == F.col(f"__e_{PART}")]
    return rows.join(ends, on).drop(*[f"__e_{c}" for c in [*by, PART]])
