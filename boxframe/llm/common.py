"""Helpers shared by the training-data operators.

Column names that start with ``__bf_`` are reserved for the operators' own use.
"""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Separators of whitespace words: the complement of ``[^\x20\x09-\x0D]``.
SPACE_RUN = r"[\x09-\x0D\x20]+"
#: The same as characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a session in local mode, whose executors are this machine, gets a temporary folder; on a cluster the setting
    is needed.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="boxframe-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of the queries inside go when each query ends: what they led to stands in the shared folder."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back.

    It cuts the lineage, so a lost executor costs no more than the tasks that it ran, and Spark knows
    the size of what it reads, which lets it choose broadcasts by a measured size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/boxframe-{uuid.uuid4().hex}/{name}"
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            remove(df.sparkSession, file.rsplit("/", 2)[0])


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library made in the shared one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getName().startswith("boxframe-"):
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def text_hash(text: Column) -> Column:
    """64 bits of a text; null and '' differ. With the doc_id it identifies a row's content."""
    return F.xxhash64(text.isNull(), text)


def small(df: DataFrame, bound_rows: int) -> bool:
    """True if a stored table has at most bound_rows rows: the check that every broadcast here is behind."""
    return df.limit(bound_rows + 1).count() <= bound_rows


def broadcast_if_small(df: DataFrame, bound_rows: int) -> DataFrame:
    """Marks df for broadcast only when it was counted to be within the bound; else Spark shuffles both sides."""
    return F.broadcast(df) if small(df, bound_rows) else df


def join_split(rows: DataFrame, keys: DataFrame, by: list[str], n: str, bound_rows: int = 200_000, hot: int = 10_000) -> DataFrame:
    """rows joined with keys (a stored table without repeats in by, whose column n counts the rows that each of them joins).

    Too many keys for a broadcast are merged; those of more than hot rows are still broadcast, if they are few, so that the merge has no
    hot key. They are at most one in hot rows.
    """
    if small(keys, bound_rows):
        return rows.join(F.broadcast(keys), by)
    often = stored(keys.where(F.col(n) > hot), "hot_keys")
    if not small(often, bound_rows):
        return rows.join(keys.hint("merge"), by)
    rest = rows.join(F.broadcast(often.select(by)), by, "left_anti").join(keys.where(F.col(n) <= hot).hint("merge"), by)
    return rows.join(F.broadcast(often), by).unionByName(rest)


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), evaluated on df's finished columns.

    Catalyst pushes filters below projections and repeats their expressions there, inside lambdas once per
    element. It does not push below a projection with a row number.
    """
    return df.withColumn("__bf_row", F.monotonically_increasing_id()).where(condition & (F.col("__bf_row") >= 0)).drop("__bf_row")


def ship(module: str) -> None:
    """Sends a module's functions to executors by value, so that the package need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
