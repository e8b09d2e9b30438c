"""JSON forms of the tables, columnar JSON of rendered pages, and what reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RENDERED = ("text", "x", "y", "w", "h", "font_family", "font_size", "font_weight", "color", "tag", "cls", "t_ms", "mutation_type")


def row(columns: list[str]) -> Column:
    """An object with its keys in alphabetical order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def table(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """One array of objects per key, in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*sorted(columns)).alias("__v"))))
    return df.groupBy(key).agg(F.to_json(F.transform(rows, lambda r: r["__v"]), {"ignoreNullFields": "false"}).alias("json"))


def columnar(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """One object per key: n and an array per field, rows by y, x."""
    rows = F.array_sort(F.collect_list(F.struct("y", "x", F.struct(*fields).alias("__v"))))
    g = df.groupBy(key).agg(rows.alias("r"))
    pick = lambda f: lambda s: s["__v"][f]
    parts = [F.transform("r", pick(f)).alias(f) for f in fields]
    return g.select(key, F.to_json(F.struct(F.size("r").alias("n"), *parts), {"ignoreNullFields": "false"}).alias("json"))


def from_columnar(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows of columnar JSON: parallel arrays zipped."""
    schema = "n int, " + ", ".join(f"{f} array<{t}>" for f, t in fields.items())
    keep = [c for c in df.columns if c != "json"]
    return df.withColumn("j", F.from_json("json", schema)).select(*keep, F.inline(F.arrays_zip(*[F.col(f"j.{f}").alias(f) for f in fields])))
