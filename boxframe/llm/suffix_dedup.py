"""Suffix-array dedup: bytes covered by long strings that start anywhere else are removed.

A string is MIN bytes; every place where one begins is a start. The starts are dealt to buckets such that equal strings always meet:
of the GRAM-byte substrings inside a string the one with the least hash is its anchor, and equal
strings have equal anchors at equal places. Neighbouring starts with one anchor form a row with its context, the bytes
that their strings cover; contexts do not share a start. A bucket holds the contexts of all
anchors with equal bytes. Buckets of one context are dropped; contexts that occur twice repeat wholly and are kept once.

Buckets of several contexts go to shards. A shard's contexts are joined, and threshold-bounded interval expansion on their
Burrows-Wheeler transform finds the common prefixes: breadth-first, each interval of suffixes that begin with a
string w is extended backwards to those of the strings cw, which marks the boundaries between suffixes with
common prefixes of 0, 1, 2, ... bytes, and stops at MIN. Suffixes without a boundary between them have MIN bytes in common.

A bucket of more than HOT contexts would not fit a shard. Its starts are compared as single strings by
128 bits of hash, aggregated with map-side combining.

Defined results: null is empty; texts below MIN bytes keep everything; repeated rows are copies of each other
and lose whatever a copy loses; null doc_ids are documents like others; matches never cross documents; an
empty table gives an empty result. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import grams, prefix
from .common import broadcast_if_small, ship, stored, text_hash

ship(__name__)

MIN, GRAM = 400, 160
#: Starts that are looked at together; longer texts are cut, as rows need not hold all starts of an anchor.
PIECE = 1 << 20
SHARD_BYTES = 1 << 21
HOT = 8_192
MAX_BROADCAST = 50_000
ROW = "key long, ctx long, doc_id long, th long, lo long, n int"


# -- anchors --------------------------------------------------------------------------------------


def anchor_rows(data: np.ndarray, least: int = MIN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, lo, n) of the rows of a text: the anchor's hash, the first start and the number of starts."""
    out = []
    for at in range(0, max(0, len(data) - least + 1), PIECE):
        h = grams(prefix(data[at : at + PIECE + least - 1]), gram)
        # Hash and place in one number: a minimum tells both, and ties go to the left.
        m = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        width, have = least - gram + 1, 1
        while 2 * have <= width:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < width:
            m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
        place = (m & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        out.append((h[place[lo]].view(np.int64), at + lo, np.diff(np.r_[lo, len(place)])))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            text = b.column("bytes")[i].as_py()
            key, lo, n = anchor_rows(np.frombuffer(text, np.uint8))
            if not len(key):
                continue
            view = memoryview(text)
            ctx = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + m + MIN - 1]) for a, m in zip(lo.tolist(), n.tolist(), strict=True)), np.uint64, len(lo)).view(np.int64)
            same = lambda name, i=i, k=len(key): pa.array([b.column(name)[i].as_py()] * k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx), same("doc_id"), same("th"), pa.array(lo), pa.array(n.astype(np.int32))], ["key", "ctx", "doc_id", "th", "lo", "n"])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_hash(F.col("text")).alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))


# -- Burrows-Wheeler transform --------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of an array of symbols below 512 in the order of their first ``depth`` symbols or more."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key[: n - k] |= text[k:].astype(np.int64) + 1
    have = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        if have >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - have] += rank[have:] + 1
        have *= 2


def boundaries(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """bound[j]: the suffixes order[j - 1] and order[j] have fewer than ``depth`` symbols in common.

    text ends with its only 0. Interval expansion level by level: level v holds the intervals of strings of v symbols that
    ended where no boundary was known; extended by one symbol in front, they mark the boundaries of common prefixes of v.
    """
    n = len(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # the suffix one symbol longer
    step[by_symbol] = np.arange(n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)  # the nearest places with an equal symbol
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    left, right = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(depth):
        size = right - left
        owner = np.repeat(np.arange(len(left)), size)
        at = np.arange(len(owner)) + np.repeat(left - np.cumsum(size) + size, size)
        first, last = before[at] < np.repeat(left, size), after[at] >= np.repeat(right, size)
        # Each symbol in an interval has one first and one last place; both lists are put in symbol order.
        a = np.sort(owner[first] * n + step[at[first]]) % n
        b = np.sort(owner[last] * n + step[at[last]]) % n + 1
        new = ~bound[b]
        left, right = a[new], b[new]
        bound[right] = True
        if not len(left):
            break
    return bound


def repeated_starts(contexts: list[bytes], least: int = MIN) -> list[np.ndarray]:
    """For each context a mask of its starts (its first len - least + 1 places): the string there occurs elsewhere in them."""
    lengths = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(lengths + 1)
    text = np.zeros(ends[-1] + 1, np.uint16)  # 0 ends all, 1 each context
    for c, e in zip(contexts, ends.tolist(), strict=True):
        text[e - 1 - len(c) : e - 1] = np.frombuffer(c, np.uint8)
        text[e - 1 - len(c) : e - 1] += 2
        text[e - 1] = 1
    order = suffix_array(text, least)
    close = ~boundaries(text, order, least)
    twin = np.zeros(len(text), bool)
    twin[order[close[:-1] | close[1:]]] = True
    starts = np.maximum(lengths - least + 1, 0)
    return [twin[e - 1 - k : e - 1 - k + m] for e, k, m in zip(ends.tolist(), lengths.tolist(), starts.tolist(), strict=True)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    lo = np.flatnonzero(edge == 1)
    return lo, np.flatnonzero(edge == -1) - lo


def _expand(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of repeated starts of a shard's contexts; those known to repeat wholly only serve as partners."""
    out = []
    for row, mask in zip(pdf.itertuples(), repeated_starts(list(pdf.bytes)), strict=True):
        if not row.multi:
            lo, n = _runs(mask)
            out += [(row.doc_id, row.th, row.lo + int(a), int(k)) for a, k in zip(lo, n, strict=True)]
    return pd.DataFrame(out, columns=["doc_id", "th", "lo", "n"]).astype({"doc_id": "Int64", "th": "int64", "lo": "int64", "n": "int32"})


def _single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes for each start of hot contexts."""
    for b in batches:
        for i in range(b.num_rows):
            text, doc, th, lo, multi = (b.column(c)[i].as_py() for c in ("bytes", "doc_id", "th", "lo", "multi"))
            n = len(text) - MIN + 1
            a = grams(prefix(np.frombuffer(text, np.uint8)), MIN).view(np.int64)
            view = memoryview(text)
            h = np.fromiter((xxhash.xxh3_64_intdigest(view[k : k + MIN]) for k in range(n)), np.uint64, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(h), pa.array([doc] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(np.arange(lo, lo + n)), pa.array([multi] * n)], ["h1", "h2", "doc_id", "th", "lo", "multi"])


# -- the operator ---------------------------------------------------------------------------------


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, th, lo, n: runs of starts whose strings occur elsewhere; th tells texts of one doc_id apart."""
    texts = _documents(docs)
    rows = stored(texts.where(F.octet_length("bytes") >= MIN).mapInArrow(_anchors, ROW), "anchors")
    keys = rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("rows > 1")
    keys = stored(keys.select("key", (F.col("c0") != F.col("c1")).alias("mixed")), "keys")
    met = stored(rows.join(broadcast_if_small(keys, MAX_BROADCAST), "key"), "met")
    whole = met.where("not mixed").select("doc_id", "th", "lo", "n")

    # Buckets of several contexts: one row of each context, which says whether the context is repeated itself.
    each = met.where("mixed").groupBy("key", "ctx").agg(F.min(F.struct("doc_id", "th", "lo", "n")).alias("r"), (F.count("*") > 1).alias("multi"))
    each = stored(each.select("key", "ctx", "r.*", "multi"), "contexts")
    copied = each.where("multi").select("key", "ctx")
    whole = whole.unionByName(met.where("mixed").join(broadcast_if_small(stored(copied, "copied"), MAX_BROADCAST), ["key", "ctx"], "left_semi").select("doc_id", "th", "lo", "n"))

    sizes = each.groupBy("key").agg(F.count("*").alias("m"))
    hot = stored(sizes.where(F.col("m") > HOT).select("key"), "hot")
    wanted = each.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "lo", "n", "multi")).alias("rows"))
    wanted = wanted.withColumnsRenamed({"doc_id": "__bf_d", "th": "__bf_t"})
    found = texts.join(stored(wanted, "wanted").hint("merge"), F.col("doc_id").eqNullSafe(F.col("__bf_d")) & (F.col("th") == F.col("__bf_t")))
    cut = F.transform("rows", lambda r: F.struct(r.key.alias("key"), r.lo.alias("lo"), r.multi.alias("multi"), F.substring(F.col("bytes"), (r.lo + 1).cast("int"), r.n + MIN - 1).alias("bytes")))
    found = stored(found.select("doc_id", "th", F.inline(cut)), "cut")

    total = found.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    any_hot = not hot.isEmpty()
    cold = found.join(broadcast_if_small(hot, MAX_BROADCAST), "key", "left_anti") if any_hot else found
    runs = cold.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(_expand, "doc_id long, th long, lo long, n int")
    runs = whole.unionByName(runs)
    if any_hot:
        single = stored(found.join(hot, "key", "left_semi").mapInArrow(_single_strings, "h1 long, h2 long, doc_id long, th long, lo long, multi boolean"), "single")
        twice = single.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
        one = single.join(twice, ["h1", "h2"], "left_semi").where("not multi")
        runs = runs.unionByName(one.select("doc_id", "th", "lo", F.lit(1).alias("n")))
    return runs


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes what the runs of starts cover."""
    for b in batches:
        size, removed, count, kept = [], [], [], []
        for text, runs in zip(b.column("bytes"), b.column("runs"), strict=True):
            text, runs = text.as_py(), runs.as_py() or []
            out, upto, spans, gone = [], 0, 0, 0
            end = -1
            for r in sorted((r["lo"], r["lo"] + r["n"] + MIN - 1) for r in runs):
                if r[0] > end:
                    spans += 1
                    out.append(text[upto : r[0]])
                    gone += r[1] - r[0]
                    end = upto = r[1]
                elif r[1] > end:
                    gone += r[1] - end
                    end = upto = r[1]
            out.append(text[upto:])
            size.append(len(text))
            removed.append(gone)
            count.append(spans)
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes), one row per row of docs."""
    docs = docs.select("doc_id", "text")
    per = repeated(docs).groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "n")).alias("runs"))
    per = stored(per.withColumnsRenamed({"doc_id": "__bf_d", "th": "__bf_t"}), "runs")
    rows = _documents(docs).join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__bf_d")) & (F.col("th") == F.col("__bf_t")), "left")
    return rows.select("doc_id", "bytes", "runs").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
