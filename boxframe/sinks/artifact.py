"""Content-addressed Parquet artifacts of parsed documents, committed batch by batch.

A batch lies in folders of its own number: boxes first, by bands of pages and sorted by page, y and x within a document, then the
headers, whose success mark is the commit. A batch that was killed has no mark: nothing reads it, and writing the number again
replaces it. Every document has a status: write; metadata-only (a known format without boxes); rejected (no bytes, or no
format that a reader knows); dedup (its SHA-256 is committed already, or came before in its batch). Rejected contents have a header, so they
are not parsed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.store import exists, folders, stored
from ..sources import documents

#: Pages of a band, the unit that a page range skips without reading it.
BAND = 16
STATUSES = ("write", "metadata-only", "rejected", "dedup")


def batches(spark: SparkSession, folder: str, below: int | None = None) -> list[int]:
    """The numbers of the committed batches."""
    found = [int(n.removeprefix("batch=")) for n in folders(spark, f"{folder}/headers") if n.startswith("batch=")]
    return sorted(n for n in found if (below is None or n < below) and exists(spark, f"{folder}/headers/batch={n}/_SUCCESS"))


def headers(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """sha, status, n_boxes and the document's fields of all committed batches."""
    paths = [f"{folder}/headers/batch={n}" for n in batches(spark, folder, below)]
    return spark.read.option("basePath", f"{folder}/headers").parquet(*paths) if paths else None


def commit(df: DataFrame, folder: str, number: int, content: str = "content", parse: Callable[[DataFrame], DataFrame] = documents.parse) -> dict[str, int]:
    """Parses and commits what batches before this number lack of df (doc_id, content); returns how many documents have each status.

    parse takes doc_id and content to doc_id, doc and bboxes; documents that it cannot read have no row.
    """
    spark = df.sparkSession
    rows = df.select("doc_id", F.col(content).cast("binary").alias("content")).withColumn("sha", F.sha2("content", 256))
    new = rows.where("sha is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.min("content").alias("content"))
    if (seen := headers(spark, folder, number)) is not None:
        new = new.join(seen.select("sha"), "sha", "left_anti")
    new = stored(new, "new")
    parsed = stored(parse(new.select(F.xxhash64("sha").alias("doc_id"), "content")).select(F.col("doc_id").alias("h"), "doc", "bboxes"), "parsed")
    told = new.select("sha", "doc_id", F.xxhash64("sha").alias("h")).join(parsed, "h", "left").drop("h")
    boxes = told.select("sha", F.inline("bboxes")).withColumn("band", F.floor(F.col("page_id") / BAND).cast("int"))
    boxes.repartition("band", "sha").sortWithinPartitions("band", "sha", "page_id", "y", "x").write.mode("overwrite").option("compression", "zstd").partitionBy("band").parquet(f"{folder}/boxes/batch={number}")
    n = F.coalesce(F.size("bboxes"), F.lit(0))
    status = F.when(F.col("doc").isNull(), "rejected").when(n == 0, "metadata-only").otherwise("write")
    seen_now = Observation()
    kept = told.select("sha", "doc_id", status.alias("status"), n.cast("long").alias("n_boxes"), "doc.*").observe(seen_now, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/headers/batch={number}")
    out = {s: int(seen_now.get[s]) for s in STATUSES}
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("sha").isNull()).alias("none")).first()
    fresh = sum(out.values())
    return out | {"rejected": out["rejected"] + total["none"], "dedup": total["n"] - total["none"] - fresh}


def write(df: DataFrame, folder: str, content: str = "content") -> int:
    """Commits df as the next batch; returns how many documents were new and readable."""
    done = batches(df.sparkSession, folder)
    counts = commit(df, folder, done[-1] + 1 if done else 0, content)
    return counts["write"] + counts["metadata-only"]


def scan(spark: SparkSession, folder: str, first_page: int | None = None, last_page: int | None = None) -> DataFrame:
    """The boxes of all committed batches, of pages first_page to last_page (from 0, both included).

    Bands outside of the range are left out when files are listed; within a band the range reaches the row groups.
    """
    paths = [f"{folder}/boxes/batch={n}" for n in batches(spark, folder)]
    paths = [p for p in paths if any(n.startswith("band=") for n in folders(spark, p))]
    if not paths:
        return spark.createDataFrame([], f"sha string, {documents.BOX}, band int, batch int")
    rows = spark.read.option("basePath", f"{folder}/boxes").parquet(*paths)
    if first_page is not None:
        rows = rows.where((F.col("page_id") >= first_page) & (F.col("band") >= first_page // BAND))
    if last_page is not None:
        rows = rows.where((F.col("page_id") <= last_page) & (F.col("band") <= last_page // BAND))
    return rows
