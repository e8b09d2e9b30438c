"""Near-duplicates by shingles: the components of texts whose sets of five-word shingles have a Jaccard
similarity of at least 0.8.

SimHash comes first: the fingerprints of the sets are searched in the vantage-point shards of ``simhash``, and what lies within its
radius is verified by the exact similarity and joined to components. Fingerprints of a similarity of 0.8 may lie much
further apart than any radius that prunes, so an exact search follows for the pairs of different components.

A prefix-filtered set join finds every such pair. All shingles have one order, common ones last; two sets of
similarity 4/5 share one of the first n / 5 + 1 shingles of each, so texts that share such a key, and whose sizes
and positions allow it, are candidates. Candidates are verified by the exact similarity. A sample only shapes the
order; any order finds all pairs.

Equal sets are one point. All pairs of points of different components that share a key are counted by shared keys, and those
compared that share enough. A dense group would make the square of its points, so rounds go first for
keys whose pairs far outnumber their points: they compare the key's points with HUBS of them only, the first in an order by hash that
changes every round, ever more, and join what they find to components. The rounds only spare work: every link between components that
they leave is found afterwards. What remains quadratic is the number of components that hold one key and are not linked.

Defined results: words are lower-cased in ASCII; a text of fewer than five words is one shingle; texts without
words (null, '') are equal; sets and texts are told apart by 64 bits of hash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import ascii_lower, broadcast_if_small, discard, ship, space_words, stored, text_hash
from .simhash import majority

ship(__name__)

SHINGLE = 5
#: One text of this many, by hash, has its shingles counted; those found this often are common, the commonest so many at most.
SAMPLE, COMMON, MAX_COMMON = 16, 3, 1 << 20
BROADCAST = 200_000
#: A round for each entry: what makes a key wide, and with how many of a key's points all are compared.
WIDE, HUBS = (64, 64), (16, 64)
#: A round asks for this part of the shared keys, as a pair meets under its hub's keys only.
STAR_SHARE = 0.34


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The id and the sorted distinct shingles of each row."""
    h = batch.column("__bf_h")
    flat, offsets = h.values.to_numpy(), h.offsets.to_numpy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        s = np.unique(flat[a:b])
        yield int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True), s


def _shingled(docs: DataFrame) -> DataFrame:
    """doc_id, th and __bf_h, the hashes of the shingles in the order of the text."""
    w = docs.select("doc_id", text_hash(F.col("text")).alias("th"), space_words(ascii_lower(F.col("text"))).alias("w"))
    return w.select("doc_id", "th", simhash.shingles("w", SHINGLE).alias("__bf_h"))


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sets = [], []
        for i, s in _sets(b):
            ids.append(i)
            sets.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["sid", "s"])


def shingle_sets(docs: DataFrame) -> DataFrame:
    """sid and s, the set of shingles, one row per row of docs."""
    return _shingled(docs).mapInArrow(_set_batches, "sid long, s array<long>")


def _prefixes(common: np.ndarray, count: np.ndarray) -> Callable:
    """Rows with sid, fp (the fingerprint of the set), n (its size) and prefix, its first n // 5 + 1 shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, firsts, whole = [], [], [], []
            for i, s in _sets(b):
                whole.append(s)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, count[at], 0), kind="stable")]
                ids.append(i)
                sizes.append(len(s))
                firsts.append(s[: len(s) // 5 + 1])
            fp = majority(np.concatenate([np.zeros(0, np.int64), *whole]), np.cumsum([0, *sizes]))
            new = [pa.array(ids, pa.int64()), pa.array(fp), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *new], ["doc_id", "th", "sid", "fp", "n", "prefix"])

    return run


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, th, sid, fp, n and prefix, one row per row of docs."""
    part = shingle_sets(docs.where(F.pmod(text_hash(F.col("text")), F.lit(SAMPLE)) == 0)).select(F.explode("s").alias("h"))
    common = part.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON).orderBy(F.desc("c"), "h").limit(MAX_COMMON).toPandas().sort_values("h")
    run = _prefixes(common.h.to_numpy(np.int64), common.c.to_numpy(np.int64))
    return _shingled(docs).mapInArrow(run, "doc_id long, th long, sid long, fp long, n long, prefix array<long>")


def _sizes_allow(x: str, y: str) -> Column:
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _pairs(found: DataFrame, share: float = 1.0) -> DataFrame:
    """The pairs a, b of the points x and y of rows, one row per shared key, that may have a similarity of 4/5.

    The overlap must be 4/9 of both sizes together. Where the first shared key stands bounds it; and of the two the point whose
    prefix ends first in the order has met all partners of its prefix, so what it shares is at most the
    shared keys and what follows its prefix. share: the part of the needed shared keys to ask for, where not all of a pair's are rows.
    """
    n, m = F.col("x.n"), F.col("y.n")
    place = 9 * F.least(n - F.col("x.pos"), m - F.col("y.pos")) >= 4 * (n + m)
    need = 4 * (n + m) - 9 * F.greatest(n - F.expr("x.n div 5") - 1, m - F.expr("y.n div 5") - 1)
    each = found.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"), place.alias("place"), need.alias("need"))
    return each.groupBy("a", "b").agg(F.count("*").alias("c"), F.bool_or("place").alias("place"), F.max("need").alias("need")).where(f"place and 9 * c >= {share} * need").select("a", "b")


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs a, b (a stored table) with a similarity of at least 4/5."""
    ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    # Copies share a text: the sets are made from one row of each point.
    texts = stored(points.join(ids, "sid", "left_semi").select(F.col("least.th").alias("__bf_th"), F.col("least.doc_id").alias("__bf_id")), "texts")
    rows = docs.select("doc_id", "text", text_hash(F.col("text")).alias("__bf_th"))
    rows = rows.join(broadcast_if_small(texts, BROADCAST), (rows["__bf_th"] == texts["__bf_th"]) & F.col("doc_id").eqNullSafe(F.col("__bf_id")), "left_semi")
    sets = stored(shingle_sets(rows), "sets")
    # Repeated rows have their set more than once, and so their pairs.
    both = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
    same = F.size(F.array_intersect("s", "t"))
    out = stored(both.where(9 * same >= 4 * (F.size("s") + F.size("t"))).select("a", "b"), "links")
    discard(texts, sets)
    return out


def near_fingerprints(points: DataFrame) -> DataFrame:
    """a, b: pairs of points (a stored table) that span those whose fingerprints are within simhash's radius, each once."""
    leads = stored(points.groupBy("fp").agg(F.min("sid").alias("lead"), F.count("*").alias("m")), "leads")
    equal = points.select("sid", "fp").join(broadcast_if_small(stored(leads.where("m > 1"), "equal"), BROADCAST), "fp").where("sid > lead")
    close = stored(simhash.link(leads.select("fp")).distinct(), "close")
    close = close.join(leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(leads.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    pairs = equal.select(F.col("lead").alias("a"), F.col("sid").alias("b")).unionByName(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return stored(pairs.distinct(), "fingerprint_pairs")


def _kept(rows: DataFrame, held: DataFrame, columns: list[Column | str]) -> DataFrame:
    """These columns of the rows whose key is held."""
    held = stored(held.select("key"), "open")
    out = stored(rows.join(broadcast_if_small(held, BROADCAST), "key", "left_semi").select(*columns), "rows")
    discard(held)
    return out


def _shared(points: DataFrame) -> DataFrame:
    """key, x and root of the points by keys that several points have. Each point is its own root here, so counting needs no roots."""
    keys = points.select("sid", "n", F.posexplode("prefix").alias("pos", "key"))
    held = stored(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "open")
    # Merged at any size: the keys grow with the texts, and so what is shuffled stays in proportion.
    out = stored(keys.join(held.hint("merge"), "key", "left_semi").select("key", F.struct("sid", "n", "pos").alias("x"), F.col("sid").alias("root")), "rows")
    discard(held)
    return out


def _open(rows: DataFrame, much: int = 0) -> DataFrame:
    """The rows of keys whose pairs of points of different components outnumber the points ``much`` times."""
    held = rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c").cast("double") * F.col("c")).alias("q"))
    return _kept(rows, held.where((F.col("m").cast("double") * F.col("m") - F.col("q")) / 2 > much * F.col("m")), ["key", "x", "root"])


def _moved(rows: DataFrame, links: list[DataFrame]) -> DataFrame:
    """rows with the roots of the components of the links."""
    comp = stored(simhash.components(reduce(DataFrame.unionByName, links)), "joined")
    node = rows.select("key", "x", F.col("x.sid").alias("node"))
    return node.join(broadcast_if_small(comp, BROADCAST), "node", "left").select("key", "x", F.coalesce("root", "node").alias("root"))


def _untested(pairs: DataFrame, tested: list[DataFrame]) -> DataFrame:
    return reduce(lambda p, t: p.join(t, ["a", "b"], "left_anti"), tested, pairs)


def link(points: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links that span the components of the points sid, fp, n, prefix, least (a stored table)."""
    tested = [near_fingerprints(points)]
    links = [verified(tested[0], points, docs)]
    rows = _shared(points)
    wide = _open(_moved(rows, links), WIDE[0])
    for turn, much in enumerate(WIDE):
        if turn:
            wide, before = _open(_moved(wide, links), much), wide
            discard(before)
        if wide.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("x.sid", F.lit(turn)), "x.sid"))
        hubs = wide.withColumn("rank", rank).where(F.col("rank") <= HUBS[turn]).select("key", F.col("x").alias("y"), F.col("root").alias("of_y"))
        star = _pairs(wide.join(hubs, "key").where((F.col("root") != F.col("of_y")) & _sizes_allow("x", "y")), STAR_SHARE)
        tested.append(stored(_untested(star, tested), "stars"))
        links.append(verified(tested[-1], points, docs))
    discard(wide)
    rows, before = _open(_moved(rows, links)), rows
    discard(before)
    met = rows.join(rows.select("key", F.col("x").alias("y"), F.col("root").alias("of_y")), "key")
    rest = _pairs(met.where((F.col("root") < F.col("of_y")) & _sizes_allow("x", "y")))
    rest = stored(_untested(rest, tested), "rest")
    links.append(verified(rest, points, docs))
    discard(rows, rest, *tested)
    return reduce(DataFrame.unionByName, links)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, th and group (a point of the component), one row per row of docs."""
    rows = stored(prefixes(docs), "prefixes")
    points = stored(rows.groupBy("sid").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min(F.struct("doc_id", "th")).alias("least")), "points")
    rows, before = stored(rows.select("doc_id", "th", "sid"), "ids"), rows
    discard(before)
    links = link(points, docs)
    comp = stored(simhash.components(links), "components")
    out = stored(rows.join(broadcast_if_small(comp, BROADCAST), F.col("sid") == F.col("node"), "left").select("doc_id", "th", F.coalesce("root", "sid").alias("group")), "classes")
    discard(rows, points, comp)
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, as simhash.representatives chooses it."""
    return simhash.representatives(docs, classes(docs))
