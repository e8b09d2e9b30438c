"""Tables as streams: slices of a table arrive one after another, and a query takes each in a run of its own.

Every run starts the query anew from its checkpoint, as after a lost driver. Input, checkpoint and output are in the folder that all
executors share; the output goes through the file sink, which writes every micro-batch once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.store import shared_dir

FAR = "2200-01-01 00:00:00"


def closing(df: DataFrame, time: str) -> DataFrame:
    """One row of df's columns, null but for a time far ahead: it moves the watermark past all that came before."""
    row = df.sparkSession.range(1)
    return row.select(*[(F.to_timestamp(F.lit(FAR)) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])


def replay(df: DataFrame, slice_of: Column, slices: int, folder: str, start: Callable[[DataFrame], DataStreamWriter], time: str | None = None) -> None:
    """Runs start(stream) over the slices 0, 1, ... of df, then over a closing row if a time column is named. Other rows never arrive."""
    spark = df.sparkSession
    parts = [df.where(slice_of == k) for k in range(slices)] + ([closing(df, time)] if time else [])
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/input")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/input")
        start(stream).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/boxframe-{uuid.uuid4().hex}"


def appended(df: DataFrame, slice_of: Column, slices: int, build: Callable[[DataFrame], DataFrame], time: str) -> DataFrame:
    """What build(stream) has appended after all slices and the closing row."""
    folder, shapes = new_folder(df.sparkSession), []

    def start(stream: DataFrame) -> DataStreamWriter:
        out = build(stream)
        shapes.append(out.schema)
        return out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/output")

    replay(df, slice_of, slices, folder, start, time)
    return df.sparkSession.read.schema(shapes[-1]).parquet(f"{folder}/output")
