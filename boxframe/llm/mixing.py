"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key ``-ln(u) / weight``, where u is a hash of seed and doc_id and the weight is
the document's quality. Sorted by key within its source, the documents' sizes are prefix-summed
to the source's budget. A target of e whole epochs and a rest takes every document e times and the rest by
key; the document in which the rest ends is taken in part.

A source may hold a third of all rows, so no task sees a whole source: the keys are cut
into ordered bins, the bins' sums tell in which bin the rest ends, and only this
bin's rows are prefix-summed to find the one place at which it ends. Bins are equal steps of the key's logarithm, whose
density is at most 1/e for an exponential key of any weight: a bin of 1/n holds at most a share 1/(e n) of the documents,
whatever their weights, and n follows the rows. All documents are then
compared with their source's place, row by row, without a sort.

Defined results: null text has size 0; null sources form the last source; ties in the key are broken by
doc_id (null first) and the text's hash; rows equal in all of them share what their place takes evenly;
an empty table gives an empty result. Input columns that clash with a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, broadcast_if_small, space_words, stored, text_hash

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 5
MIN_BINS = 1024
BIN_ROWS = 50_000
MAX_BROADCAST_SOURCES = 100_000


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.2 and 1: lower the more characters per word are not in a word of letters (symbols and digits)."""
    t = F.coalesce(text, F.lit(""))
    odd = F.octet_length(t) - F.octet_length(F.translate(t, "0123456789#*$%&|<>", ""))
    return F.greatest(F.lit(0.2), F.lit(1.0) - F.try_divide(odd.cast("double"), size * 2.0))


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1): 52 bits of an MD5, so that reruns and other engines agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (bits.cast("long") + 0.5) / float(2**52)


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: source_size and target.

    Sources weigh 1, 2, 3, repeating, by code point order. The excess over MAX_EPOCHS times a source's size
    is reshared by weight until none is above: sources sorted by capacity per weight are filled
    in that order, which gives the same end state in one pass. One row per source is all these windows see.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("w_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.col("cap_before")) / F.col("w_left")
    s = s.withColumn("full", F.col("cap") <= F.col("w") * level)
    # Sources that are not full all stand behind the full ones and share the level of the first, the highest.
    s = s.withColumn("level", F.max(F.when(~F.col("full"), level)).over(Window.partitionBy()))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level")).alias("target"))


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with size and the place in the sampling order: __bf_key, __bf_id, __bf_th."""
    rows = docs.withColumn("size", F.size(space_words(F.col("text"))).cast("long"))
    key = -F.log(uniform(F.col("doc_id"), seed)) / quality_weight(F.col("text"), F.greatest("size", F.lit(1)))
    return rows.withColumns({"__bf_key": key, "__bf_id": F.coalesce(F.col("doc_id"), F.lit(-(2**63))), "__bf_th": text_hash(F.col("text"))})


def key_bin(key: Column, bins: int) -> Column:
    return F.floor(F.log(key) * bins)


def plan(narrow: DataFrame) -> DataFrame:
    """One row per source: source_size, target, whole epochs, and the place at which the rest ends.

    ``narrow`` has source, size and the place; it is read three times and should be stored.
    """
    t = targets(narrow).withColumn("__bf_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = stored(t.withColumn("__bf_rest", F.floor("target").cast("long") - F.col("__bf_epochs") * F.col("source_size")), "targets")
    t = t.withColumnRenamed("source", "__bf_source")
    bins = max(MIN_BINS, narrow.count() // BIN_ROWS)
    binned = narrow.withColumn("bin", key_bin(F.col("__bf_key"), bins))
    cut = binned.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    cut = cut.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bin")) - F.col("n"))
    same = lambda a: F.col(a).eqNullSafe(F.col("__bf_source"))
    hit = cut.join(broadcast_if_small(t, MAX_BROADCAST_SOURCES), same("source")).where((F.col("before") < F.col("__bf_rest")) & (F.col("__bf_rest") <= F.col("before") + F.col("n")))
    hit = stored(hit.select("__bf_source", F.col("bin").alias("__bf_bin"), "before", "__bf_rest"), "bins")
    place = ["__bf_key", "__bf_id", "__bf_th"]
    rows = binned.join(broadcast_if_small(hit, MAX_BROADCAST_SOURCES), same("source") & (F.col("bin") == F.col("__bf_bin")))
    # Equal places are one entry, which its rows share evenly.
    rows = rows.groupBy("__bf_source", "before", "__bf_rest", *place).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("__bf_source").orderBy(*place))
    rows = rows.withColumn("upto", upto).where((F.col("upto") - F.col("n") < F.col("__bf_rest")) & (F.col("__bf_rest") <= F.col("upto")))
    share = F.expr("(__bf_rest - (upto - n)) div m")
    ends = rows.select(F.col("__bf_source").alias("__bf_end"), F.struct(*place).alias("__bf_cut"), share.alias("__bf_share"))
    return stored(t.join(ends, F.col("__bf_source").eqNullSafe(F.col("__bf_end")), "left").drop("__bf_end"), "plan")


def take(keyed_docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to keyed documents, row by row."""
    out = keyed_docs.drop("source_size", "target", "taken")
    out = out.join(broadcast_if_small(plan, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("__bf_source")), "left")
    place = F.struct("__bf_key", "__bf_id", "__bf_th")
    part = F.when(F.col("__bf_cut").isNull() | (place > F.col("__bf_cut")), F.lit(0)).when(place < F.col("__bf_cut"), F.col("size")).otherwise(F.col("__bf_share"))
    out = out.withColumn("taken", (F.col("__bf_epochs") * F.col("size") + part).cast("long"))
    return out.drop("__bf_epochs", "__bf_rest", "__bf_source", "__bf_key", "__bf_id", "__bf_th", "__bf_cut", "__bf_share")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and taken: the words that the mix takes of each, repeats counted."""
    rows = keyed(docs, seed)
    return take(rows, plan(stored(rows.select("source", "size", "__bf_key", "__bf_id", "__bf_th"), "keys")))
