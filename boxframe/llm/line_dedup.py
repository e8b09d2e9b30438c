"""Line dedup: later occurrences of repeated three-line windows are removed.

The lines of a text are what ``\n`` separates. Every three consecutive lines form a window; windows overlap. Of the
occurrences of equal windows in the corpus, ordered by doc_id (null first), then the text's hash, then position,
the first stays; the lines that any later occurrence covers are removed. Every line's text survives at
least once, as a removed line's counterpart in the first occurrence lies strictly earlier.

Windows are hashed to 128 bits. Occurrences are reduced to the first of each hash with map-side
combining, so a passage that a third of all documents share costs each task a row.

Defined results: null stays null and has no lines; texts of fewer than three lines are never changed;
rows equal in doc_id and text are one document, whose result each of them gets; an empty table gives an
empty result. Input columns that clash with a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored, text_hash

LINES = 3
MAX_BROADCAST_WINDOWS = 200_000
#: A window that occurs more often than this is hot.
HOT_WINDOW = 10_000


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """id, th, pos, h1, h2 of every window."""
    rows = docs.select(F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("th"), F.split("text", "\n").alias("l"))
    rows = rows.withColumn("x", F.transform("l", lambda s: F.xxhash64(s))).withColumn("y", F.transform("l", lambda s: F.xxhash64(F.lit(1), s))).drop("l")
    over = lambda a, i: F.xxhash64(*[F.get(a, i + k) for k in range(lines)])
    each = F.transform(F.sequence(F.lit(0), F.size("x") - lines), lambda i: F.struct(i.alias("pos"), over("x", i).alias("h1"), over("y", i).alias("h2")))
    return rows.select("id", "th", F.inline(F.when(F.size("x") >= lines, each)))


def later(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """id, th and pos: sorted positions of later occurrences, one row per document that has any."""
    w = windows(docs, lines)
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.max(F.struct("id", "th", "pos")).alias("last"), F.count("*").alias("n"))
    repeated = stored(first.where("first < last").select("h1", "h2", "first", "n"), "repeated_windows")
    hits = occurrences(w, repeated).where(F.struct("id", "th", "pos") > F.col("first"))
    return hits.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("pos"))


def occurrences(w: DataFrame, repeated: DataFrame) -> DataFrame:
    """The windows that are repeated (a stored table), with first.

    Too many of them for a broadcast are merged; those that occur often are still broadcast, if they are few, so that the merge has
    no hot key. They are at most one in HOT_WINDOW windows.
    """
    by, columns = ["h1", "h2"], ["id", "th", "pos", "first"]
    if small(repeated, MAX_BROADCAST_WINDOWS):
        return w.join(F.broadcast(repeated), by).select(columns)
    hot = stored(repeated.where(F.col("n") > HOT_WINDOW), "hot_windows")
    if not small(hot, MAX_BROADCAST_WINDOWS):
        return w.join(repeated.hint("merge"), by).select(columns)
    rest = w.join(F.broadcast(hot.select(by)), by, "left_anti").join(repeated.where(F.col("n") <= HOT_WINDOW).hint("merge"), by)
    return w.join(F.broadcast(hot), by).select(columns).unionByName(rest.select(columns))


def dedup(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """docs with text shortened, and n_lines and n_removed (long)."""
    spans = stored(later(docs, lines).withColumnsRenamed({"id": "__bf_id", "th": "__bf_th", "pos": "__bf_pos"}), "later")
    # Rows of spans are as long as their documents, so nothing bounds a broadcast: both sides are always merged.
    rows = docs.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__bf_id")) & (text_hash(F.col("text")) == F.col("__bf_th")), "left")
    # The sorted positions become merged stretches, which are cut from the array of lines.
    merged = F.aggregate(
        "__bf_pos",
        F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<a:int,b:int>>").alias("keep")),
        lambda a, p: F.struct((p + lines).alias("upto"), F.when(p > a.upto, F.concat(a.keep, F.array(F.struct(a.upto.alias("a"), p.alias("b"))))).otherwise(a.keep).alias("keep")),
        lambda a: F.concat(a.keep, F.array(F.struct(a.upto.alias("a"), F.size("__bf_l").alias("b")))),
    )
    rows = rows.withColumn("__bf_l", F.split("text", "\n")).withColumn("__bf_keep", F.when(F.col("__bf_pos").isNotNull(), merged))
    left = F.flatten(F.transform(F.filter("__bf_keep", lambda s: s.b > s.a), lambda s: F.slice("__bf_l", s.a + 1, s.b - s.a)))
    rows = rows.withColumn("__bf_left", left)
    n = F.coalesce(F.size("__bf_l"), F.lit(0))
    rows = rows.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"),
            "n_removed": F.when(F.col("__bf_left").isNull(), 0).otherwise(n - F.size("__bf_left")).cast("long"),
            "text": F.when(F.col("__bf_left").isNull(), F.col("text")).otherwise(F.array_join("__bf_left", "\n")),
        }
    )
    return rows.drop("__bf_id", "__bf_th", "__bf_pos", "__bf_l", "__bf_keep", "__bf_left")
