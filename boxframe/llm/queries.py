"""The training-data operators as registered queries: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, line_dedup, mixing, quality_classifier, quality_rules, secrets, simhash, spelling, suffix_dedup, toxicity, url_filters, warc
from .common import stored

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without later occurrences, n_lines, n_removed."""
    return line_dedup.dedup(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.digest(decontaminate.contamination(docs, items))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a ledger at the path in boxframe.secrets.ledger, only what it lacks is scanned; else every distinct text is."""
    docs, ledger = _table(spark, sf_dir, "documents", "doc_id", "text"), spark.conf.get("boxframe.secrets.ledger", None)
    return secrets.scan_with_ledger(docs, ledger) if ledger else secrets.scan_documents(docs)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(_table(spark, sf_dir, "documents", "doc_id", "text")))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.keyed(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    rows = stored(rows.drop("text"), "keys")
    return mixing.take(rows, mixing.plan(rows)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality_rules.judge(docs, carry_text=False).select("doc_id", *quality_rules.FEATURES, "base_failed", "kept")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_classifier.score(docs, quality_classifier.train(docs, labels))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text", "lang"), _table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.classes(_table(spark, sf_dir, "documents", "doc_id", "text")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return hard_negatives.mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deduplicated archives hold, read back from them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("key"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    names = {"key": "page_id", "size": "payload_bytes", "digest": "payload_digest", "type": "record_type", "origin": "refers_to"}
    return warc.round_trip(pages).select(*[F.col(k).alias(v) for k, v in names.items()])


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(_table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Query]:
    each = [op1_line_dedup, op2_decontamination, op3_secret_scan, op4_suffix_dedup, op5_source_mixing, op6_quality_rules, op7_url_filters, op8_quality_classifier, op9_toxicity, op10_simhash, op11_hard_negatives, op12_warc_revisits, op13_spelling_variants]
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
