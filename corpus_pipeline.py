"""A corpus pipeline of five training-data operators, each stage written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
The stages accept what their operators accept: nulls, empty tables, repeated rows and further columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxframe.llm import decontaminate, line_dedup, mixing, quality_rules, shingle_dedup
from boxframe.llm.common import filtered, stored


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its own columns of these names renamed, and what restores docs' columns in a result."""
    own = {c: f"__bf_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(own), lambda out: out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows, restored = _aside(docs, [*quality_rules.FEATURES, "base_failed", "kept"])
    return restored(quality_rules.judge(rows).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated lines; a document of which no word is left goes."""
    rows, restored = _aside(docs, ["n_lines", "n_removed"])
    out = line_dedup.dedup(rows)
    gone = F.coalesce((F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return restored(filtered(out, ~gone))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8), the one with the smallest doc_id."""
    return shingle_dedup.representatives(docs).select(docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.remove(docs, items).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken."""
    return filtered(mixing.mix(docs), F.col("taken") > 0).select([c for c in docs.columns if c not in ADDED] + ADDED)


ADDED = ["size", "source_size", "target", "taken"]
STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("benchmark decontamination", benchmarks), ("mixing sources", mixture)]
#: SQL has no XXH64, which shingles are hashed by; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
