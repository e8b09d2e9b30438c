"""Benchmark decontamination by a prefix-filtered set join (native: DataFrame functions only).

An item's windows are ``WINDOW`` consecutive words, or all words of a shorter item. Windows and documents are sets of
positioned shingles of ``SHINGLE`` words (fewer for the windows of tiny items). One pass over the documents keeps
the shingles that the benchmark has at all. Their counts order the shingles by rarity. Since
a window must be contained wholly, the necessary prefix is its one rarest shingle: windows meet documents only there.
Positional bounds (the window must begin at or after the text's first word) and length bounds (the
document must have as many shingles around the meeting place as the window) follow, then the shingle
sequence of shingles is compared, by 128-bit hashes of their words.

Defined results: null has no words; a document without words is clean; items without words match nothing;
items with null or repeated ids count as their distinct ids (a null id counts in no item list);
repeated rows get equal results; empty tables give clean documents or an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, stored, text_hash

WINDOW = 10
SHINGLE = 3
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark shingles and windows beyond these are shuffled instead of broadcast.
MAX_BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """win (its words), n (their number) and item_id, distinct."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.slice("w", i + 1, n)))
    return items.select("item_id", at.alias("win")).distinct().withColumn("n", F.size("win"))


def key(x: Column | str, y: Column | str, at: Column, k: int = SHINGLE) -> list[Column]:
    """128 bits of the k words from a position, of the arrays of their hashes; what lies behind the end counts nothing."""
    return [F.xxhash64(*[F.get(a, at + j) for j in range(k)]).alias(name) for a, name in ((x, "h1"), (y, "h2"))]


def hashed(words: Column) -> tuple[Column, Column]:
    return F.transform(words, lambda w: F.xxhash64(w)), F.transform(words, lambda w: F.xxhash64(F.lit(1), w))


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, list[int]]:
    """(win_id, n, parts: their shingles in order), (h1, h2, k, sid) of the shingles, and the shingle lengths in use."""
    distinct = windows.select("win", "n").distinct().withColumn("k", F.least("n", F.lit(shingle)))
    # Ids are 128 bits of the words, so nothing has to be numbered.
    ident = lambda c: F.md5(c)
    parts = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("k")), lambda i: F.array_join(F.slice("win", i + 1, F.col("k")), " "))
    distinct = stored(distinct.select(ident(F.array_join("win", " ")).alias("win_id"), "n", "k", parts.alias("parts")), "windows")
    # Words have no bounded length, so shingles meet by 128 bits of hash and are named by 128 others.
    shingles = stored(distinct.select(F.explode("parts").alias("shingle"), "k").distinct().select(*key(*hashed(F.split("shingle", " ")), F.lit(0)), "k", F.md5("shingle").alias("sid")), "shingles")
    lengths = sorted(r.k for r in shingles.select("k").distinct().collect())  # at most SHINGLE values
    return distinct, shingles, lengths


def shingle_hits(docs: DataFrame, shingles: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per distinct document: doc_id, th, copies, n_words, and hits: sorted (k, pos, sid) of benchmark shingles.

    Each document also emits a mark, which an outer join keeps, so documents without a hit stay and no
    second pass is needed. Marks have the document's own hash as key: they meet nothing and no one task.
    """
    known = broadcast_if_small(shingles, MAX_BROADCAST_SHINGLES)
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("th"), words(F.col("text")).alias("w"))
    x, y = hashed(F.col("w"))
    rows = rows.select("doc_id", "th", F.size("w").alias("n_words"), x.alias("x"), y.alias("y"))
    none = F.array().cast("array<struct<pos:int,h1:bigint,h2:bigint>>")
    all_of = lambda k: F.when(F.col("n_words") >= k, F.transform(F.sequence(F.lit(0), F.col("n_words") - k), lambda i: F.struct(i.alias("pos"), *key("x", "y", i, k)))).otherwise(none)
    mark = F.struct(F.lit(-1).alias("pos"), F.xxhash64("doc_id", "th").alias("h1"), F.col("th").alias("h2"))
    mine = F.concat(F.array(mark), *[all_of(k) for k in lengths])
    rows = rows.select("doc_id", "th", "n_words", F.inline(mine)).join(known, ["h1", "h2"], "left").where("pos < 0 or sid is not null")
    hit = F.when(F.col("pos") >= 0, F.struct("k", "pos", "sid"))
    return rows.groupBy("doc_id", "th").agg(F.sum(F.when(F.col("pos") < 0, 1).otherwise(0)).alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"))


def occurrences(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, th, win_id, pos and n of every place where a window occurs."""
    rarity = stored(hits.select(F.explode("hits").alias("h")).groupBy("h.sid").agg(F.count("*").alias("freq")), "rarity")
    # Shingles in no document rule out their windows; of the others the rarest is the prefix.
    each = windows.select("win_id", F.posexplode("parts").alias("off", "shingle")).withColumn("sid", F.md5("shingle"))
    counted = each.join(rarity, "sid", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    prefix = counted.groupBy("win_id").agg(F.min(F.struct("freq", "sid", "off")).alias("p"), F.array_sort(F.collect_list(F.struct("off", "sid"))).alias("order"))
    prefix = prefix.where("p.freq > 0").join(windows.select("win_id", "n", "k"), "win_id")
    prefix = stored(prefix.select("win_id", "n", "k", F.col("p.sid").alias("sid"), F.col("p.off").alias("off"), F.transform("order", lambda o: o.sid).alias("sids")), "prefix")
    reach = WINDOW - 1
    # Each hit goes out with the few hits around it: what a window could cover.
    near = F.transform("hits", lambda h, i: F.struct(h.k.alias("k"), h.pos.alias("pos"), h.sid.alias("sid"), F.least(i, F.lit(reach)).alias("at"), F.transform(F.sequence(i - F.least(i, F.lit(reach)), F.least(i + reach, F.size("hits") - 1)), lambda j: F.get("hits", j)).alias("around")))
    met = hits.where(F.size("hits") > 0).select("doc_id", "th", F.inline(near)).join(broadcast_if_small(prefix, MAX_BROADCAST_SHINGLES), ["sid", "k"])
    # Length and position bounds, then the exact sequence.
    first = F.col("at") - F.col("off")
    m = F.size("sids")
    met = met.where((F.col("pos") >= F.col("off")) & (first >= 0) & (first + m <= F.size("around")))
    # Catalyst may compute the slice before the bounds are tested, so its start is kept valid.
    cover = F.slice("around", F.greatest(first, F.lit(0)) + 1, m)
    met = met.withColumn("cover", cover).where((F.col("cover")[0].pos == F.col("pos") - F.col("off")) & (F.element_at("cover", -1).pos == F.col("pos") - F.col("off") + m - 1) & (F.transform("cover", lambda c: c.sid) == F.col("sids")))
    return met.select("doc_id", "th", "win_id", (F.col("pos") - F.col("off")).alias("start"), "n")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, th, n_words, n_hit, item_ids (sorted strings), contaminated."""
    windows = stored(item_windows(benchmark), "item_windows")
    distinct, shingles, lengths = window_shingles(windows)
    hits = stored(shingle_hits(docs, shingles, lengths), "hits")
    found = stored(occurrences(hits, distinct), "occurrences")
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a.n + F.greatest(x.end - F.greatest(x.start, a.upto), F.lit(0))).alias("n"), F.greatest(x.end, a.upto).alias("upto")),
        lambda a: a.n,
    )
    covered = found.groupBy("doc_id", "th").agg(merged.alias("n_hit"))
    owners = windows.select(F.md5(F.array_join("win", " ")).alias("win_id"), F.col("item_id").cast("string").alias("item")).distinct()
    items = found.select("doc_id", "th", "win_id").distinct().join(broadcast_if_small(stored(owners, "owners"), MAX_BROADCAST_SHINGLES), "win_id")
    items = items.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = covered.withColumnsRenamed({"doc_id": "__bf_d", "th": "__bf_t"}).join(items.withColumnsRenamed({"doc_id": "__bf_e", "th": "__bf_u"}), F.col("__bf_d").eqNullSafe(F.col("__bf_e")) & (F.col("__bf_t") == F.col("__bf_u")), "left")
    base = hits.select("doc_id", "th", "n_words", "copies")
    out = base.join(per, F.col("doc_id").eqNullSafe(F.col("__bf_d")) & (F.col("th") == F.col("__bf_t")), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "th", "copies", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("item_ids"), (hit > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    rows = found.withColumn("__bf_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents, all columns as given."""
    bad = stored(contamination(docs.select("doc_id", "text"), benchmark).where("contaminated").select(F.col("doc_id").alias("__bf_d"), F.col("th").alias("__bf_t")), "contaminated")
    bad = broadcast_if_small(bad, 200_000)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bf_d")) & (text_hash(F.col("text")) == F.col("__bf_t")), "left_anti")
