"""Relational tables as pages of boxes: what a report of orders per customer looks like.

One document per customer: a title, then for each order status a section label, a header row and a row per order; 40
rows a page, rows 20 apart, columns 110 apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLACK

#: Bytes of orders for a partition; sizes above the other are no sizes but mean that Spark doesn't know.
PART, UNKNOWN = 1 << 20, 1 << 50
ROWS, STEP, LEFT, COLUMN = 40, 20, 40, 110
HEADER = ("Order", "Total", "Date", "Priority", "Year")


def cents(c) -> F.Column:
    n = F.round(c * 100).cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(100)).cast("string"), 2, "0"))


def _dealt(orders: DataFrame) -> DataFrame:
    """orders dealt by doc_id to at least a partition for each PART bytes: each makes dozens of boxes, which Spark can't see by the size of the exchange."""
    size = int(orders._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return orders.repartition(max(n, size // PART) if size < UNKNOWN else n, "doc_id")


def order_boxes(orders: DataFrame) -> DataFrame:
    """One exchange, of the orders by customer: their places on the page come from ranks, and titles, sections and headers from the first orders of their group."""
    o = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("priority"))
    o = _dealt(o)
    doc = Window.partitionBy("doc_id")
    group, bare = doc.orderBy("status"), F.when(F.col("status").isNull(), 1)
    o = o.withColumn("n", F.row_number().over(doc.orderBy("status", "k"))).withColumns({"__g": F.dense_rank().over(group), "__first": F.rank().over(group)}).withColumn("__bare", F.count(bare).over(doc).cast("int"))
    # Rows without a status come before the title.
    r = F.col("n") + 2 * F.col("__g") - F.coalesce(bare, F.lit(0))
    texts = F.array(F.col("k").cast("string"), F.concat(F.lit("$"), cents(F.col("total"))), F.col("day").cast("string"), "priority", F.year("day").cast("string"))
    row = lambda kind, at, t: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("r"), t.alias("texts"))
    starts = F.col("n") == F.col("__first")
    title = F.when(F.col("n") == 1, row(-1, F.when(F.col("__bare") > 0, F.col("__bare") + 2).otherwise(0), F.array(F.concat(F.lit("Orders of customer "), F.col("doc_id").cast("string")))))
    section = F.when(starts, row(0, r - 2, F.array(F.concat(F.lit("Status "), F.col("status")))))
    header = F.when(starts, row(1, r - 1, F.array(*map(F.lit, HEADER))))
    rows = o.select("doc_id", F.inline(F.filter(F.array(title, section, header, row(2, r, texts)), lambda x: x.isNotNull())))
    b = rows.select("doc_id", "kind", "r", F.posexplode("texts").alias("c", "text"))
    bold = F.col("kind") < 2
    indent = F.when(F.col("kind") > 0, 8).otherwise(0)
    return b.select(
        "doc_id", F.floor(F.col("r") / ROWS).cast("int").alias("page_id"), (F.col("r").cast("long") * 10 + F.col("c")).alias("ord"), (LEFT + indent + F.col("c") * COLUMN).cast("double").alias("x"), ((F.pmod(F.col("r"), F.lit(ROWS)) + 1) * STEP).cast("double").alias("y"),
        (F.length("text") * 6).cast("double").alias("w"), F.when(F.col("kind") == -1, 16.0).otherwise(10.0).alias("h"), "text", (F.when(F.col("kind") == -1, 0).when(F.col("kind") == 0, 1).when(F.col("kind") == 1, 2).otherwise(3)).alias("style_id"),
        F.when(bold, "bold").otherwise("normal").alias("weight"), F.when(F.col("kind") == -1, 16.0).otherwise(10.0).alias("font_size"), F.lit("Helvetica").alias("font_name"), F.when(F.col("kind") == 0, "rgba(0,0,128,255)").otherwise(BLACK).alias("color"),
    )
