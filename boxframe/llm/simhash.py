"""SimHash near-duplicates by vantage-point trees.

A fingerprint has 64 bits, of the hashes of a text's three-word shingles the majority bit by bit. The JVM tokenises
and hashes; Arrow hands the hashes to numpy, which sums the bits. Only distinct fingerprints are
compared, so a group of copies is one point, however large.

A vantage-point tree over a bounded sample of the points cuts Hamming space into shards: each node splits by
the median distance to its vantage point. Every point has one home shard and visits, as a query, the other shards
that its ball of radius RADIUS overlaps by the triangle inequality. Of two shards only the lower-numbered one's
points need visit. Within a shard the same tree goes on down to small leaves, which are compared
exactly. The sample only shapes the tree; every point is routed and all links are found.

Shards return spanning links instead of all pairs: dense groups never expand. Components are
then found with rounds of large-star and small-star steps over tables in the shared folder.

Cost: a query visits all shards but a share that shrinks with depth as 0.73 ** depth, so work grows
as about the 1.55th power of distinct fingerprints; see README.

Defined results: texts without words (null, '') have fingerprint zero and link like any other; null doc_ids
link but never name a component, whose id is null if it has no other; repeated rows get equal results;
an empty table gives an empty result. Input columns that clash with a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, discard, ship, small, space_words, stored, text_hash

ship(__name__)

RADIUS = 2
SHINGLE = 3
#: Fingerprints of the sample that shapes the tree; a bound on what the driver ever sees.
SAMPLE = 65_536
#: Documents that leave are told by a broadcast of this many ids at most; more are told by a join.
LEAVING = 1_000_000
SHARD_POINTS = 8_192
#: Visitors of a shard that one task compares with its points.
VISITORS = 65_536
LEAF = 48
#: Points of the sample below which they shape no node.
THIN = 8
#: Shingle hashes that numpy unpacks at a time.
CHUNK = 1 << 16


# -- fingerprints ---------------------------------------------------------------------------------


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each list of 64-bit hashes; offsets has one more entry than there are lists."""
    counts = np.diff(offsets)
    ones = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + CHUNK]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    set_bits = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.int64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = b.column("__bf_h")
        offsets = h.offsets.to_numpy().astype(np.int64)
        fp = majority(h.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "th")), pa.array(fp)], ["doc_id", "th", "fp"])


def shingles(w: str, k: int) -> Column:
    """The hashes of the k-word shingles of the words in column w; a text of fewer words is one shingle."""
    run = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))
    n = F.size(w)
    whole = F.when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), run)).otherwise(whole)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash) and fp (the fingerprint as a signed long), one row per row of docs."""
    w = docs.select("doc_id", text_hash(F.col("text")).alias("th"), space_words(ascii_lower(F.col("text"))).alias("w"))
    return w.select("doc_id", "th", shingles("w", SHINGLE).alias("__bf_h")).mapInArrow(_fingerprint_batches, "doc_id long, th long, fp long")


# -- vantage-point trees --------------------------------------------------------------------------


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part the points, the nearer half inside; None if nothing parts them."""
    for vantage in (points[0], points[len(points) // 2], ~points[0] ^ (points[-1] >> np.uint64(1))):
        d = _distance(points, vantage)
        radius = int(np.median(d))
        for r in (radius, radius - 1):
            if 0 < np.count_nonzero(d <= r) < len(points):
                return vantage, r
    return None


def build(sample: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inner, outer) of a tree with about that many leaves; a child below 0 is shard -child - 1.

    Where the sample is too thin to shape a node, its vantage point is drawn and its radius is half of the bits.
    """
    nodes: list[list[int]] = []
    leaves, drawn = 0, np.random.default_rng(10)

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal leaves
        if want <= 1:
            leaves += 1
            return -leaves
        part = _split(points) if len(points) >= THIN else None
        if part is None:
            part = drawn.integers(0, 1 << 64, dtype=np.uint64), 32
        at = len(nodes)
        nodes.append([int(part[0]), part[1], 0, 0])
        near = _distance(points, part[0]) <= part[1]
        nodes[at][2] = grow(points[near], want // 2)
        nodes[at][3] = grow(points[~near], want - want // 2)
        return at

    root = grow(sample, shards)
    return [tuple(n) for n in nodes] if root >= 0 else []


def route(tree: list[tuple[int, int, int, int]], points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, shard, whether it is the point's home) for homes and for higher-numbered shards to visit."""
    if not tree:
        return np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    stack = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    found = []
    while stack:
        at, idx, home = stack.pop()
        if at < 0:
            found.append((idx, np.full(len(idx), -at - 1), home))
            continue
        vantage, radius, inner, outer = tree[at]
        d = _distance(points[idx], np.uint64(vantage)).astype(np.int64)
        near, far = d - RADIUS <= radius, d + RADIUS > radius
        stack.append((inner, idx[near], home[near] & (d[near] <= radius)))
        stack.append((outer, idx[far], home[far] & (d[far] > radius)))
    idx, shard, home = (np.concatenate(x) for x in zip(*found, strict=True))
    of = np.empty(len(points), np.int64)
    of[idx[home]] = shard[home]
    wanted = home | (shard > of[idx])
    return idx[wanted], shard[wanted], home[wanted]


class _Forest:
    """Union-find over positions of an array."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links(points: np.ndarray, homes: int, among: bool = True) -> list[tuple[int, int]]:
    """Spanning links between positions of points within RADIUS; the first ``homes`` points are the shard's own.

    Every link of which one end is a home is found or implied by the returned ones; without ``among`` only those to visitors.
    """
    forest, out = _Forest(len(points)), []
    stack = [(np.arange(homes), np.arange(0 if among else homes, len(points)))]
    while stack:
        own, asks = stack.pop()
        if not len(own) or not len(asks):
            continue
        part = _split(points[own]) if len(own) > LEAF else None
        if part is None:  # compare in blocks, so that a dense ball needs no square of memory
            step = max(1, (1 << 20) // len(own))
            for at in range(0, len(asks), step):
                close = np.bitwise_count(points[asks[at : at + step], None] ^ points[own][None, :]) <= RADIUS
                for a, b in zip(*np.nonzero(close), strict=True):
                    x, y = int(asks[at + a]), int(own[b])
                    if x != y and forest.join(x, y):
                        out.append((x, y))
            continue
        vantage, radius = part
        d, e = _distance(points[own], vantage), _distance(points[asks], vantage).astype(np.int64)
        stack.append((own[d <= radius], asks[e - RADIUS <= radius]))
        stack.append((own[d > radius], asks[e + RADIUS > radius]))
    return out


def _shard_links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["home", "fp"], ascending=[False, True])
    fp = pdf.fp.to_numpy()
    pairs = np.array(links(fp.view(np.uint64), int(pdf.home.sum()), bool((pdf.block == 0).all())), np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})


def link(distinct: DataFrame) -> DataFrame:
    """a, b: links that span the components of the distinct fingerprints fp (a stored table)."""
    n = distinct.count()
    shards = int(2 ** np.ceil(np.log2(max(1, n / SHARD_POINTS))))
    tree: list[tuple[int, int, int, int]] = []
    if shards > 1:
        sample = distinct.select("fp", F.xxhash64("fp").alias("r")).orderBy("r").limit(SAMPLE).toPandas().fp.to_numpy()
        tree = build(sample.view(np.uint64), shards)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            idx, shard, home = route(tree, fp.view(np.uint64))
            for at in range(0, len(idx), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(shard[s]), pa.array(fp[idx[s]]), pa.array(home[s])], ["shard", "fp", "home"])

    spread = stored(distinct.mapInArrow(routed, "shard long, fp long, home boolean"), "routed")
    # A shard's visitors are dealt to blocks, each of which meets all of the shard's points.
    sizes = spread.groupBy("shard").agg(F.ceil(F.count_if(~F.col("home")) / VISITORS).cast("int").alias("blocks")).where("blocks > 1")
    spread = spread.join(broadcast_if_small(stored(sizes, "blocks"), 200_000), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    one = F.array(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    spread = spread.select("shard", "fp", "home", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(one)).alias("block"))
    return spread.groupBy("shard", "block").applyInPandas(_shard_links, "a long, b long")


# -- components -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of the edges a, b.

    Rounds of large-star and small-star: each node passes its neighbourhood's minimum on, as joins of edge
    lists with aggregated minima; the number of rounds grows with the logarithm of the largest diameter.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, before = stored(large.where("a > b").distinct(), "large"), e
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = stored(small.where("a > b").distinct(), "small")
        discard(large, before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select("b", "b").toDF("node", "root").distinct())


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, group (a fingerprint of the component) and component_id (the smallest doc_id reachable), one row per row of docs."""
    rows = stored(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = stored(components(link(least.select("fp"))), "components")
    # Only points with a link take part in the join of components; all others keep their own least doc_id.
    ids = comp.join(least, comp.node == least.fp).groupBy("root").agg(F.min("least").alias("of_root"))
    comp = stored(comp.join(broadcast_if_small(stored(ids, "ids"), 200_000), "root"), "named")
    named = least.join(broadcast_if_small(comp, 200_000), least.fp == comp.node, "left")
    named = named.select(F.col("fp").alias("__bf_fp"), F.coalesce("root", "fp").alias("group"), F.coalesce("of_root", "least").alias("component_id"))
    return rows.join(named, F.col("fp") == F.col("__bf_fp"), "left").drop("__bf_fp")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """docs with one row of each group of found (a stored table; default: classes), the one with the smallest doc_id, then text hash; all columns as given."""
    found = stored(classes(docs), "classes") if found is None else found
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("m"))
    best = stored(best.select(F.col("m.doc_id").alias("__bf_d"), F.col("m.th").alias("__bf_t")).distinct(), "representatives")
    here = F.col("doc_id").eqNullSafe(F.col("__bf_d")) & (F.col("__bf_th") == F.col("__bf_t"))
    out = docs.withColumn("__bf_th", text_hash(F.col("text")))
    ids = found.select(F.col("doc_id"), F.col("th").alias("__bf_th")).distinct()
    gone = stored(ids.join(best, here, "left_anti").toDF("__bf_d", "__bf_t"), "leaving")
    # The texts need not move to leave out a few.
    out = out.join(F.broadcast(gone), here, "left_anti") if small(gone, LEAVING) else out.join(best, here, "left_semi")
    if found.count() > found.select("doc_id", "th").distinct().count():
        # Repeated rows: their representative stands there more than once.
        out = out.withColumn("__bf_n", F.expr("row_number() over (partition by doc_id, __bf_th order by doc_id)")).where("__bf_n = 1").drop("__bf_n")
    return out.drop("__bf_th")
